"""Every query with SQL against DuckDB; the others against brute force."""

import datetime
import hashlib
import json
import math
import os
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from fundloom.operators import export
from fundloom.plans.queries import QUERIES, SQL, records_of_pages
from fundloom.sources.carrier import fund_docs

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x.isoformat() if isinstance(x, datetime.date) else x

    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_all_others_are_tested_below():
    assert set(QUERIES) - set(SQL) == {"page_text", "text_features", "confidence_boost"}


def shown_lines(html):
    """Lines by events: each text node is handed to all open elements that make lines."""
    lines, stack = [], []

    class Events(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in {"h1", "h2", "h3", "h4", "p", "li", "td", "th", "span", "div"} and not any(t in ("script", "style", "noscript") for t, _ in stack):
                lines.append([])
                stack.append((tag, len(lines) - 1))
            elif tag not in {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}:
                stack.append((tag, None))

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not any(t in ("script", "style", "noscript") for t, _ in stack):
                for _, k in stack:
                    if k is not None:
                        lines[k].append(data.strip())

    events = Events()
    events.feed(html)
    events.close()
    return list(dict.fromkeys(t for t in ("".join(x) for x in lines) if len(t) > 1))


def test_page_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["page_text"](spark, SF).collect():
        text = "\n".join(shown_lines(pages[r.page_id]))
        assert r.text == text and r.word_count == len(text.split())


def test_features_and_boost(spark):
    rng, layers = np.random.default_rng(42), (512, 1024, 1024, 512, 256, 128)
    weights = [(rng.standard_normal((a, b)) * np.sqrt(2.0 / a)).astype(np.float32) for a, b in zip(layers[:-1], layers[1:], strict=True)]

    def forward(text):
        x = np.zeros(512, np.float32)
        raw = (text or "").encode()[:512]
        x[: len(raw)] = np.frombuffer(raw, np.uint8) / np.float32(255)
        for w in weights[:-1]:
            x = np.maximum(x @ w, 0)
        return 1 / (1 + np.exp(-(x @ weights[-1])))

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["text_features"](spark, SF).collect():
        want = forward(texts[r.doc_id])
        assert np.allclose(r.features, want, atol=1e-4) and r.mean == pytest.approx(float(want.mean()), abs=1e-4)
    sheets = {r.doc_id: r.text for r in fund_docs(spark, SF).collect()}
    base = {"isin": 0.95, "nav": 0.92}
    for r in QUERIES["confidence_boost"](spark, SF).collect():
        assert r.confidence == pytest.approx(min(1.0, base[r.entity_type] + float(forward(sheets[r.doc_id]).mean()) * 0.05), abs=1e-5)


def test_written_files(spark, tmp_path):
    rows = records_of_pages(spark, SF).where("doc_id < 5")
    jobs = rows.select("doc_id").distinct().selectExpr("doc_id", "'{\"job_id\": 1}' as trail", "cast(7.5 as double) as quality_score")
    tmp_path = export.write_files(rows, str(tmp_path), jobs)
    packages = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert len(packages) == 5 and len({p["content_hash"] for p in packages}) == 5
    for p in packages:
        assert set(p) == {"data_import", "quality_metrics", "provenance", "content_hash"} and p["provenance"] == {"job_id": 1} and p["quality_metrics"]["overall_score"] == 7.5
        data = p["data_import"]["data"]
        assert len(data) == p["data_import"]["record_count"] == 2
        assert hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest() == p["content_hash"]
        assert data[1]["TopHoldings"][0]["SecurityName"] == "Alpha Works" and list(data[1]["SectorWeights"]) == ["Energy", "Health"]
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert sheet.count() == 10 and sheet.columns[2] == "SecId"
    assert spark.read.text(f"{tmp_path}/provenance").count() == 5
