"""The registered queries over a whole table, each against its brute-force version."""

import hashlib
import re
import sys
import zlib
from array import array
from pathlib import Path

import duckdb
import numpy as np
import pytest

from hashloom.llm import bpe, licenses
from hashloom.llm import queries as registry

from conftest import SMALL

sys.path.insert(0, str(Path(__file__).parent))
from test_llm import BASE_PII, base_by_hand, components_by_hand, fingerprint_by_hand, secrets_by_hand  # noqa: E402

Q = {int(k[2:].split("_")[0]): f for k, f in registry.queries().items()}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall())


def run(spark, n, where=SMALL):
    return {r["doc_id"]: r for r in Q[n](spark, where).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_against_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(registry.oracle_sql()["op1_extendible_shards"]).fetchall()
    assert sorted(tuple(r) for r in Q[1](spark, SMALL).collect()) == sorted(want)


@pytest.mark.parametrize("n,by_hand", [(2, lambda t: base_by_hand(t, BASE_PII)), (9, secrets_by_hand)])
def test_base_spans(spark, texts, n, by_hand):
    got = run(spark, n)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = by_hand(t)
        assert got[i]["base_sha256"] == sha(want) and set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_op3(spark, texts):
    tok = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    whole = {(i, k) for i, t in texts.items() for k, x in items if tok(x) in tok(t)}
    got = {(r["doc_id"], r["item_id"]) for r in Q[3](spark, SMALL).collect()}
    assert whole and whole <= got
    # whatever else it finds agrees in 13 tokens with the item, by a plain count over all diagonals
    for i, k in got - whole:
        a, b = tok(texts[i]).split(), tok(dict(items)[k]).split()
        assert max(sum(x == y for x, y in zip(a[max(0, d) :], b[max(0, -d) :])) for d in range(-len(b), len(a))) >= min(13, 0.8 * len(b))


def test_op4_and_op7(spark, texts):
    lib = bpe.library(bpe.default_path())
    four, seven, start = run(spark, 4), run(spark, 7), 0
    for i, t in texts.items():
        e = lib.encode(t, add_special_tokens=False).ids
        ids = array("I", e)
        assert (four[i]["n_tokens"], four[i]["ids_sha256"], four[i]["decoded_sha256"]) == (len(e), hashlib.sha256(ids.tobytes()).hexdigest(), sha(lib.decode(e, skip_special_tokens=False)))
        ids.append(2)
        assert (seven[i]["start"], seven[i]["n_tokens"], seven[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5(spark, texts):
    for i, r in run(spark, 5).items():
        pay = texts[i].encode().ljust(max(1, -(-len(texts[i].encode()) // 576)) * 576, b"\xff")
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))


def test_op6(spark, texts):
    ids = list(texts)
    fps = [fingerprint_by_hand(texts[i]) for i in ids]
    root = components_by_hand(fps)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    got = run(spark, 6)
    assert all((got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, root))


def test_op8_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    got = run(spark, 8, where)
    truth = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{where}/labels.parquet' GROUP BY 1").fetchall())
    held = [(truth[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in truth]
    assert len(got) == 1000 and len(held) > 100
    assert np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([b for a, b in held if a == 0]) < 0.02


def test_op10(spark, texts):
    for i, r in run(spark, 10).items():
        assert r["places"] == ",".join(f"{k}:{f}" for k, f in licenses.families_of(texts[i]))
