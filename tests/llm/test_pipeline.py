"""Queries against their SQL, and each stage of the pipeline against a plain version of it."""

import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from tarnlake.llm import bpe, mixing, quality, queries, secrets
from tests.conftest import SF
from tests.llm.test_operators import crc, linked, sets
from tests.oracle import duck, rows


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_query_equals_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck(SF, queries.ORACLES[name]))


def test_quality_of_held_out_rows(spark):
    """Scores of rows that were not learnt from, against their labels: area under the curve and accuracy."""
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in queries.QUERIES["op8_quality_gam"](spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    good, bad = [s for s, y, _ in got if y], [s for s, y, _ in got if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 50 and len(bad) > 10 and auc >= 0.98 and np.mean([y == p for _, y, p in got]) >= 0.95


def secret_free(text, ratios):
    """The text with each run of overlapping spans replaced, by regular expressions and one table look-up per character."""
    spans = [m.span() for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base = list(spans)
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not any(s < m.end() and m.start() < e for s, e in base):
            if sum(ratios[128 * ord(a) + ord(b)] for a, b in zip(v, v[1:])) >= secrets.LEAST_RATIO:
                spans.append(m.span())
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_gam"](spark, docs, SF)
    model = quality.train(docs, labels)
    raw = {i: np.frombuffer((t or "").encode(), np.uint8) for i, t in texts.items()}
    kept = {i for i, b in raw.items() if model.score(quality.features(b, np.array([0, len(b)])))[0] >= 0.5}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == kept
    said = {r["doc_id"]: r["quality"] for r in labels.collect() if crc(r["doc_id"], 3) == 1}
    assert sum(said[i] == (i in kept) for i in said) >= 0.9 * len(said)

    one = stages["minhash_tensored"](spark, good, SF)
    s = {i: sets(texts[i]) for i in kept}
    group = linked(sorted(kept), lambda i, j: 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) > 0)
    first = {i for i in kept if group[i] == i}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == first and first < kept

    clean = stages["secret_scan"](spark, one, SF)
    ratios = secrets.ratio_table(collections.Counter((k, a, b) for t, k in secrets.samples() for a, b in zip(t, t[1:])))
    want = {i: secret_free(texts[i], ratios) for i in first}
    got = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and {i: r["text"] for i, r in got.items()} == want and any(want[i] != texts[i] for i in first)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    mixed = stages["source_mixing"](spark, clean, SF).collect()
    size = {i: len(t.split()) for i, t in want.items()}
    target = {r["source"]: r["target"] for r in mixing.targets(mixing.sizes(clean)).collect()}
    taken, copies = collections.Counter(), collections.Counter(r["doc_id"] for r in mixed)
    for r in mixed:
        assert r["text"] == want[r["doc_id"]] and r["source"] == got[r["doc_id"]]["source"]
        taken[r["source"]] += size[r["doc_id"]]
    assert max(copies.values()) <= 2 and all(abs(taken[k] - target[k]) <= max(size.values()) for k in target)

    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    coded = stages["byte_bpe"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    assert collections.Counter(r["doc_id"] for r in coded) == copies
    for r in coded:
        assert r["ids"] == t.encode_ordinary(want[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
