"""Registered queries over whole small tables, against SQL or plain Python."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers

public_tokenizers = pytest.importorskip("public_tokenizers")

from statloom.llm import registry, winnow  # noqa: E402

TABLES = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def texts():
    """Text of each document (null: empty), in order of the id."""
    return dict(sorted(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{TABLES}/documents.parquet'").fetchall()))


@pytest.fixture(scope="module")
def ids(texts):
    encoder = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return {i: encoder.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def rows_of(spark, name):
    return QUERIES[name](spark, TABLES).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    wanted = base.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(tuple(r[c] for c in columns) for r in rows_of(spark, name)) == sorted(wanted.fetchall())


@pytest.mark.parametrize("name, score", [("op2_ppm", "score"), ("op5_toxicity", "score")])
def test_folds_and_scores(spark, texts, name, score):
    rows = rows_of(spark, name)
    assert sorted(r["doc_id"] for r in rows) == list(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r[score] <= 1 for r in rows)
    if name == "op5_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    else:
        learned = {x for (x,) in duckdb.sql(f"SELECT DISTINCT lang FROM '{TABLES}/documents.parquet' WHERE lang IS NOT NULL").fetchall()}
        assert all(r["lang_pred"] in learned if any(c.isalpha() for c in texts[r["doc_id"]]) else r["lang_pred"] == "und" for r in rows)


def test_near_duplicate_classes(spark, texts):
    def bag(text):
        w = winnow.words(text)
        k = max(1, min(5, len(w)))
        return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    bags = {i: bag(t) for i, t in texts.items()}
    size, root = {i: sum(b.values()) for i, b in bags.items()}, {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in bags:
        for b in bags:
            if a < b and size[a] and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]):
                both = sum(min(n, bags[b][x]) for x, n in bags[a].items())
                if both >= 0.8 * (size[a] + size[b] - both):
                    a_, b_ = find(a), find(b)
                    root[max(a_, b_)] = min(a_, b_)
            elif a < b and texts[a] == texts[b]:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    times = collections.Counter(map(find, bags))
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows_of(spark, "op4_bagminhash")} == {i: (find(i), times[find(i)]) for i in bags}


def test_packed_pieces(spark, ids):
    rows = rows_of(spark, "op6_packing")
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_doc) == list(ids)
    for i, pieces in by_doc.items():
        own, at = [*ids[i], 1], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == crc(own[at : at + p["length"]])
            at += p["length"]
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048


def test_token_file(spark, ids):
    wanted, start = {}, 0
    for i, own in ids.items():
        wanted[i] = (start, len(own) + 1, crc([*own, 0]))
        start += len(own) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op9_dac")} == wanted


def test_repeated_strings(spark, texts):
    first, wanted = {}, {}
    for i, text in texts.items():
        x = text.encode()
        gone = np.zeros(len(x), bool)
        for at in range(len(x) - 49):
            if first.setdefault(x[at : at + 50], i) != i:
                gone[at : at + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        wanted[i] = (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(spark, "op10_suffix")} == wanted


def test_lines_and_tunes_answer_for_every_row(spark, texts):
    lines = {r["doc_id"]: r for r in rows_of(spark, "op3_simhash_lines")}
    assert sorted(lines) == list(texts) and all(0 <= r["n_removed"] <= r["n_lines"] for r in lines.values())
    seen, repeats = set(), collections.Counter()
    for i, text in texts.items():
        for line in text.split("\n"):
            repeats[i] += line in seen and any(c.isalnum() for c in line)
            seen.add(line)
    assert all(lines[i]["n_removed"] >= n for i, n in repeats.items())
    conversations = {x for (x,) in duckdb.sql(f"SELECT DISTINCT conv_id FROM '{TABLES}/conversations.parquet'").fetchall()}
    assert {r["conv_id"] for r in rows_of(spark, "op7_chroma")} == conversations
