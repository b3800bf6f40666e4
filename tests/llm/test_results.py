"""Every query on a small table against plain versions, whole."""

import math
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm import brute
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return list(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def ids(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return library, {i: library.encode(t, add_special_tokens=False).ids for i, t in docs}


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n in entry.oracle_sql()])
def test_sql(spark, name):
    verdict, count, _ = compare(spark, database(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok" and count > 0, verdict


def test_eleven_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op1_quality_rules")}
    for i, t in docs:
        r, want = got[i], brute.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 2 * want[4] > want[0]) and not (r.base_failed and r.kept)


def test_mixing(spark, docs):
    want, total = brute.unigram(docs)
    got = rows(spark, "op2_context_mixing")
    assert len(got) == len(docs)
    for r in got:
        held, n, known, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    bits = -sum(r.score for r in held) * math.log2(10) / (sum(r.n_bytes for r in held) + len(held))
    assert bits < 3.2  # order-0 bytes cost over 4


def test_token_counts(spark, docs, ids):
    _, want = ids
    for r in rows(spark, "op7_token_counts"):
        assert (r.n_tokens, r.over_limit) == (len(want[r.doc_id]), len(want[r.doc_id]) > 1024)
        assert r.n_bytes == len(dict(docs)[r.doc_id].encode())


def test_bpe(spark, ids):
    library, want = ids
    for r in rows(spark, "op8_bpe_round_trip"):
        own = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), brute.sha(",".join(map(str, own))))
        assert r.decoded_sha256 == brute.sha(library.decode(own, skip_special_tokens=False))


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op9_secret_scans")}
    names = ("assign", "access", "hex")
    for i, t in docs:
        spans, r = brute.base_secrets(t), got[i]
        written = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert r.base_sha256 == brute.sha(",".join(written)) and set(written) <= set(r.spans.split(",")) | {""}


def test_packing(spark, ids):
    _, want = ids
    got = pd.DataFrame([r.asDict() for r in rows(spark, "op10_best_fit_packing")])
    for i, own in got.groupby("doc_id"):
        own, all_ids = own.sort_values("piece"), np.array(want[i] + [0], np.uint32)
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(all_ids)
        assert len(own) == 1 if len(all_ids) <= 2048 else (own.length.iloc[1:] == 2048).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(all_ids[r.start : r.start + r.length].tobytes())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    least = -(-got.length.sum() // 2048)
    assert got.sequence_id.nunique() <= 1.02 * least + 1


def test_lines(spark, docs):
    """Lines are found by signatures: none may go wrongly, and of those at the threshold one in 200 may stay."""
    want, gone = brute.line_groups(docs)
    got = {r.doc_id: r for r in rows(spark, "op5_fuzzy_lines")}
    assert sum(r.n_removed for r in got.values()) >= 0.99 * len(gone)
    same = sum(got[i].text_sha256 == brute.sha(t) for i, t in want.items())
    assert same >= 0.98 * len(want)


def test_pipeline_stages_keep_columns_of_their_own_names(spark):
    import corpus_pipeline

    text = " ".join(f"word{i} other{i * 7 % 61}" for i in range(60))
    names = ["counts", "kept", "base_failed", "n_removed"]
    rows = [(1, text + "\nshared line of both documents", "en", "s", None), (2, text.replace("word", "term") + "\nshared line of both documents", "en", "s", None)]
    docs = spark.createDataFrame([(*r, *[f"{n} of {r[0]}" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{n}` string" for n in names))
    for number in (0, 1):
        docs = spark.createDataFrame((out := corpus_pipeline.STAGES[number][1](spark, docs, SF)).collect(), out.schema)
        assert out.columns == docs.columns and docs.count() == 2
        for r in docs.collect():
            assert [r[n] for n in names] == [f"{n} of {r.doc_id}" for n in names]


def test_pipeline(spark, docs, ids):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scans", "best_fit_packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    columns = source.columns

    def step(number, table):
        out = corpus_pipeline.STAGES[number][1](spark, table, SF)
        assert number == 4 or out.columns == columns
        return spark.createDataFrame(out.collect(), out.schema)

    first = step(0, source)
    kept = {r.doc_id: r.text for r in first.collect()}
    assert set(kept) == {r.doc_id for r in rows(spark, "op1_quality_rules") if r.kept}
    second = step(1, first)
    left, _ = brute.line_groups(sorted(kept.items()))
    texts = {r.doc_id: r.text for r in second.collect()}
    assert set(texts) <= {i for i, t in left.items() if t.split()} | {i for i, t in left.items() if t != kept[i]}
    assert sum(texts.get(i, "") == (t if t.split() else "") for i, t in left.items()) >= 0.98 * len(left)
    assert all(r.n_chars == len(r.text) for r in second.collect())
    third = step(2, second)
    near = brute.near_documents(list(texts.items()), 5)
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in near.items() if i == c}
    fourth = step(3, third)
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        assert not brute.base_secrets(r.text) or "[SECRET]" in r.text
        assert (r.text == before[r.doc_id]) == ("[SECRET]" not in r.text) and r.n_chars == len(r.text)
    packed = step(4, fourth).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in fourth.collect()}
    assert entry.queries()["pipeline"](spark, SF).count() == len(packed)
