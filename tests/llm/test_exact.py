"""Operators with exact results against brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import dac, packing, suffix, warc, winnow
from statloom.llm.common import scratch_path
from statloom.llm.tokens import encoder


def test_encoder_equals_the_library():
    enc, rnd = encoder(), random.Random(1)
    parts = ["a", "b", "The", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", ".", ",", "_", "é", "ß", "²", "½", "ª", "\xa0", "\x1c", "日本", "!", "\n\n", "\r", "–", "×", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "<p>" + "x" * 1200 + "é</p>", "<p>hi</p>"
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/\r\nX: y", big), (4, "http://d/", small), (5, "http://e/", small), (6, "http://f/", None), (None, "http://g/", big), (7, "http://h/", "z" * 1000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    rows = {r["record_id"]: r for r in warc.read_archive(spark, path, with_payload=True).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 3), 7: ("response", None)
    }
    for page_id, html in pages.select("page_id", "html").collect():
        body = (html or "").encode()
        r = rows[page_id]
        assert bytes(r["payload"]) == body and r["payload_digest"] == hashlib.sha1(body).hexdigest() and r["payload_bytes"] == len(body)
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and block == (body if r["record_type"] == "response" else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(block) - 4}".encode() in head
    assert rows[3]["uri"] == "http://c/%0D%0AX: y" and rows[2]["uri"] is None


def test_warc_detects_damage(spark, pages):
    path = scratch_path(spark, "warc-damaged")
    warc.write_archive(pages, path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    bad.write.parquet(f"{path}-b/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-b/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"{path}-b").collect()


def test_warc_empty(spark, pages):
    path = scratch_path(spark, "warc-empty")
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def brute_hits(docs, items, window=10):
    grams = [(i, n, tuple(w[s : s + n])) for i, t in items if (w := winnow.words(t or "")) for n in [min(len(w), window)] for s in range(len(w) - n + 1)]
    out = []
    for _, text in docs:
        w = winnow.words(text or "")
        hit, found = set(), set()
        for i, n, g in grams:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) == g:
                    hit.update(range(s, s + n))
                    found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_winnowing_equals_brute_force(spark, make_docs, block_bytes):
    rnd = random.Random(5)
    word = lambda: rnd.choice("a b c d e f g".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 10, 30, 4, 1, 0, 15])] + [(9, None)]
    docs = []
    for i in range(40):
        inner = rnd.choice(items)[1] or ""
        docs.append((i, None if i == 3 else " ".join([*(word() for _ in range(rnd.randint(0, 12))), inner.upper(), *(word() for _ in range(5))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked, _ = winnow.mark_contaminated(make_docs(docs), bench, block_bytes=block_bytes)
    got = sorted((r["n_words"], r["n_hit"], r["items"]) for r in marked.collect())
    assert got == brute_hits(docs, items)


def test_winnowing_handles_awkward_rows(spark, make_docs, awkward):
    bench = spark.createDataFrame([(1, awkward[0][1])], "item_id long, text string")
    marked, _ = winnow.mark_contaminated(make_docs(awkward), bench)
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in marked.collect()) == brute_hits(awkward, [(1, awkward[0][1])])
    kept = winnow.drop_contaminated(make_docs(awkward), bench)
    assert kept.columns == make_docs(awkward).columns and kept.count() == 7
    assert winnow.mark_contaminated(make_docs([]), bench)[0].count() == 0
    assert winnow.mark_contaminated(make_docs(awkward), bench.limit(0))[0].where("n_hit > 0").count() == 0


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 8, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes = dac.Codes(dac.encode(ids))
        assert len(codes) == n and (codes.span(0, n) == ids).all() and [codes[i] for i in range(n)] == ids.tolist()
        if n > 10:
            assert (codes.span(7, n - 2) == ids[7 : n - 2]).all()


def test_token_file_round_trip(spark, make_docs, awkward):
    path = scratch_path(spark, "tokens-test")
    docs = make_docs(awkward)
    dac.write_token_file(docs, path, segment_tokens=50, partitions=3)
    rows = sorted(dac.read_token_file(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    start, texts = 0, {i: t for i, t in awkward}
    for r in rows:
        ids = np.append(encoder().encode(texts[r["doc_id"]]), np.uint32(0)).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    wanted = spark.createDataFrame([(1, 0), (1, 4), (8, 59_999), (3, 0), (3, 1)], "doc_id long, position long")
    got = {(r["doc_id"], r["position"]): r["token_id"] for r in dac.tokens_at(spark, path, wanted).collect()}
    assert got == {(i, p): [*encoder().encode(texts[i]).tolist(), 0][p] for i, p in [(1, 0), (1, 4), (8, 59_999), (3, 0)]}


def test_empty_token_file(spark, make_docs):
    path = scratch_path(spark, "tokens-empty")
    dac.write_token_file(make_docs([]), path)
    assert dac.read_token_file(spark, path).count() == 0


def test_closest_fill_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(4)}
        target = rnd.randint(1, 60)
        used = packing.closest_fill(counts, target)
        assert all(n <= counts[x] for x, n in used.items())
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= target)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_keeps_every_id_once(spark, make_docs, awkward, capacity):
    docs = [(i, t) for i, t in awkward if i is not None and i != 2] + [(100 + i, "some words here " * (i % 23)) for i in range(300)]
    rows = packing.pack(make_docs(docs), capacity=capacity, pool=32, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in docs:
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        full = [*encoder().encode(text).tolist(), 1]
        assert [x for p in pieces for x in p["ids"]] == full and all(p["doc_tokens"] == len(full) for p in pieces)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0
    assert packing.pack(make_docs([])).count() == 0


def brute_strings(docs, length=50, in_order=False):
    docs = [((2**63 if i is None else i), (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in docs:
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out if in_order else sorted(out)


def brute_strings_in_order(texts, length):
    return brute_strings([(i, t.decode()) for i, t in enumerate(texts)], length, in_order=True)


def test_strings_equal_brute_force(spark, make_docs, awkward):
    rnd = random.Random(8)
    passages = ["".join(rnd.choice("abcd é") for _ in range(rnd.randint(30, 120))) for _ in range(8)]
    docs = [(i, "".join(rnd.choice(passages)[: rnd.randint(20, 120)] + rnd.choice("xyz") for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    docs += [(i if i is None else 500 + i, t) for i, t in awkward if t is None or len(t) < 1000] + [(900, "a" * 500), (901, "a" * 200), (902, "ab" * 100)]
    docs += [(1000 + i, "".join(rnd.choice(["\0" * rnd.randint(1, 60), "a" * rnd.randint(1, 20), "b\0"]) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    rows = suffix.dedup_strings(make_docs(docs)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == brute_strings(docs)
    assert suffix.dedup_strings(make_docs([])).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_zero_bytes_are_not_padding(seed):
    """What one gram's suffixes tell, against all strings, with texts of zero bytes."""
    rnd, length = random.Random(seed), 50
    texts = [bytes(rnd.choice(b"\0\0\0a") if rnd.random() < 0.2 else 0 for _ in range(rnd.randint(50, 90))) for _ in range(6)]
    s = suffix.Slice(texts, length)
    ctx, gone = suffix.contexts(s.x, s.at, s.begins, s.ends, length), [np.zeros(len(t), bool) for t in texts]
    for gram in {int(h) for h in s.h}:
        own = np.flatnonzero(s.h == gram)
        for k, mask in zip(own, suffix.earlier(ctx[own], s.doc[own], length).tolist()):
            begin = int(s.at[k] - s.begins[s.at[k]])
            for j in range(length - suffix.GRAM + 1):
                if mask >> j & 1:
                    gone[s.doc[k]][begin - j : begin - j + length] = True
    assert [t for t in map(bytes, (np.frombuffer(t, np.uint8)[~g].tobytes() for t, g in zip(texts, gone)))] == [x[3] for x in brute_strings_in_order(texts, length)]


def test_length_is_guarded(make_docs):
    for length in (16, 79):
        with pytest.raises(ValueError, match="length"):
            suffix.dedup_strings(make_docs([(1, "a")]), length=length)


def test_hot_grams_are_split(spark, make_docs, monkeypatch):
    """A passage in nearly all documents, each time in another context, meets in no task whole; results stay right."""
    rnd = random.Random(8)
    letters = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = letters(80)
    docs = [(i, letters(rnd.randint(0, 90)) + passage[rnd.randint(0, 20) :] + letters(rnd.randint(0, 90))) for i in range(60)] + [(60, None), (None, passage)]
    want = {r["doc_id"]: bytes(r["kept"]) for r in suffix.dedup_strings(make_docs(docs)).collect()}
    whole = suffix._marks
    seen = []
    monkeypatch.setattr(suffix, "_marks", lambda part, length: seen.append(suffix._contexts(part, length).groupBy("h").count().agg(F.max("count")).first()[0] or 0) or whole(part, length, 7))
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.dedup_strings(make_docs(docs), hot=5).collect()}
    assert got == want
    assert seen[0] <= 10 and any(len(got[i]) < len(docs[i][1]) for i in range(60))


def test_strings_of_a_hot_gram_travel_once_a_batch(make_docs, monkeypatch):
    """Hot contexts meet by two longer keys; where these are frequent, what a batch knows of a passage's copies is not joined. Texts move to their marks by one join."""
    rnd, write, whole, seen = random.Random(9), suffix.cut, suffix._marks, []
    letters = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = letters(90)
    docs = [(i, letters(40) + passage + letters(40)) for i in range(80)] + [(80, "short"), (81, letters(60)), (82, None)]

    def counted(df, label):
        out = write(df, label)
        if label == "strings":
            told = out.where("s1 IS NOT NULL")
            seen.append((told.count(), told.groupBy("s1", "s2").count().agg(F.max("count")).first(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(suffix, "cut", counted)
    for most in (100_000, 7):
        monkeypatch.setattr(suffix, "_marks", lambda part, length: whole(part, length, most))
        out = suffix.dedup_strings(make_docs(docs), hot=5)
        assert "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()) == brute_strings(docs)
    (none, _, _), (some, often, parts) = seen
    assert none == 0 and some and often[0] <= max(parts, 8) < 80  # by batch, not by copy


def test_long_runs_and_short_periods(spark, make_docs, monkeypatch):
    """Runs of one byte and short periods, in which nearly every place is sampled: equal contexts travel once, hot or not."""
    docs = [(1, "a" * 20_000), (2, "x" + "a" * 20_000 + "yz"), (3, "abc" * 5_000), (4, "zz" + "abc" * 4_000), (4, "bca" * 100), (5, "ab" * 30 + "a" * 70)]
    want, whole, seen = brute_strings(docs), suffix._marks, []
    monkeypatch.setattr(suffix, "_marks", lambda part, length: seen.append(suffix._contexts(part, length).count()) or whole(part, length))
    for hot in (10_000, 10**9):
        rows = suffix.dedup_strings(make_docs(docs), hot=hot).collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == want
    assert max(seen) < 2_000  # of some 65,000 places
    assert seen[0] < seen[1]  # few documents, many occurrences: hot


def test_deep_shallow_sorts():
    rng = np.random.default_rng(0)
    for n, width in ((0, 10), (1, 10), (300, 50), (9000, 34)):
        rows = rng.integers(0, 3, (n, width)).astype(np.uint8)
        if n > 1:
            rows[:, :30] = rows[rng.integers(0, max(n // 9, 1), n)][:, :30]
        got = [rows[i].tobytes() for i in suffix.deep_shallow(rows)]
        assert got == sorted(got)


def test_repeated_strings_sample_once_and_look_up_whole_batches(make_docs, monkeypatch):
    """Suffixes are sampled in steps as they are at once, and by one pass before contexts; masks are looked up as a dictionary would."""
    rnd, calls = random.Random(21), []
    texts = [bytes(rnd.choice(b"abc \x00") for _ in range(n)) for n in (0, 10, 49, 50, 700, 3000)] + [b"a" * 400, b"ab" * 300]
    s = suffix.Slice(texts, 50)
    whole = suffix._anchors(s.x, s.ends, 50)
    for step in (1, 37, 64, 1000):
        assert all((a == b).all() for a, b in zip(suffix.anchors(s.x, s.ends, 50, step), whole))
    of = np.sort(np.array([rnd.randrange(6) for _ in range(40)]))
    known = np.unique(np.array([(d, rnd.randrange(-3, 3), rnd.randrange(-3, 3)) for d in of]), axis=0)
    known = np.column_stack([known, [rnd.choice([-1, 5, 1 << 40]) for _ in known]])
    doc, name = np.array([rnd.randrange(7) for _ in range(200)]), np.array([(rnd.randrange(-3, 3), rnd.randrange(-3, 3)) for _ in range(200)])
    want = {(d, x, y): m for d, x, y, m in known.tolist()}
    got = suffix._looked_up(doc, name, known[:, 0], known[:, 1:])
    assert got.tolist() == [want.get((d, x, y), 0) for d, (x, y) in zip(doc.tolist(), name.tolist())]
    assert suffix._looked_up(doc[:0], name[:0], known[:0, 0], known[:0, 1:]).tolist() == []
    sample = suffix._sampled
    monkeypatch.setattr(suffix, "_sampled", lambda rows, length: calls.append(1) or sample(rows, length))
    docs = [(1, "x" * 60), (2, "x" * 70), (3, None)]
    assert {r["doc_id"]: r["n_removed"] for r in suffix.dedup_strings(make_docs(docs)).collect()} == {1: 0, 2: 70, 3: 0} and calls == [1]
