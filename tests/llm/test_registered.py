"""Registered queries next to their SQL; the pipeline stage by stage; nothing else needs this part."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from check import compare, duck

import corpus_pipeline
from daygrid.llm import mixing, packing, quality_rules, secret_scans
from daygrid.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, _, _, notes = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert not notes


def test_pipeline_stages(spark, con, tmp_path):
    from test_near_duplicates import joined

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            kept = {i for (i,) in con.execute(f"SELECT doc_id FROM ({ORACLES['op1_quality_rules']}) WHERE kept").fetchall()}
            assert set(after) == kept and all(after[i] == before[i] for i in after)
            assert quality_rules.PRODUCTION == "web@1"
        elif name == "ngram_jaccard_join":
            ids = sorted(before)
            classes = joined([before[i]["text"] for i in ids])
            assert set(after) == {ids[k] for k, (n, least) in enumerate(classes) if least == k}
            assert all(after[i] == before[i] for i in after)
        elif name == "secret_scans":
            assert set(after) == set(before)
            for i, r in after.items():
                assert r["n_chars"] == len(r["text"])
                left = [m for k in secret_scans.BASE for m in re.finditer(k.pattern, r["text"]) if len(m[k.group]) >= k.least]
                assert not left and (r["text"] == before[i]["text"] or secret_scans.MARK in r["text"])
        elif name == "mixing":
            assert set(after) < set(before) and all(after[i] == before[i] for i in after)
            weight = lambda rows: sum(len(r["text"]) for r in rows.values())
            assert abs(weight(after) / weight(before) - mixing.PRODUCTION.keep) < 0.15
        else:
            assert set(after) == set(before)
            assert docs.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_rest_of_the_library_does_not_need_this_part():
    for path in (ROOT / "daygrid").rglob("*.py"):
        if "llm" not in path.parts:
            assert "daygrid.llm" not in path.read_text()


def test_entry_without_this_part(tmp_path):
    for name in ("__spark_entry__.py", "daygrid"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['daygrid.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
