"""Manifest, exact copies and fill-in-the-middle on small awkward tables, against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import exact, fim, merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact copies


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_copies(pairs):
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[normal(t)].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), n == 0, sha(text)) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def found_copies(df, **how):
    return sorted((tuple(r[:5]) for r in exact.copies(df, **how).collect()), key=str)


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    whole = exact.fingerprints(data, np.array([0]))[0]
    assert whole.tolist() == [sum(int(x) * pow(b, i, exact.PRIME) for i, x in enumerate(data)) % exact.PRIME for b in exact.BASES]
    for at in (0, 1, 1023, 1024, 7777, 20_000):
        parts = [exact.fingerprints(x, np.array([0]))[0] for x in (data[:at], data[at:])]
        assert exact.combine(parts[0], at, parts[1]).tolist() == whole.tolist()


def test_one_space_as_the_pattern():
    texts = ["a \t\n b", "", "  ", "x", "\x0b\x0c", "é \x85ü", " lead", "trail \n"]
    parts = [t.encode() for t in texts]
    data, starts = exact.one_space(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts[:-1]])]))
    ends = [*starts[1:], len(data)]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == [normal(t) for t in texts]


def test_copies_of_awkward_rows(make_docs, awkward):
    pairs = [*awkward, (20, "the  quick\n" * 30_000), (21, "the quick " * 30_000), (22, "\n"), (None, None), (2, awkward[1][1] + " ")]
    assert found_copies(make_docs(pairs)) == plain_copies(pairs)
    assert found_copies(make_docs([])) == []


def test_copies_without_text_differences_are_told_apart_when_fingerprints_collide(make_docs):
    pairs = [(i, "abcd"[i % 4] + "x" * 10) for i in range(200)] + [(500, "y" * 11), (501, "z" * 3)]
    # bases of 1 add up the bytes, so that texts of other letters and equal sums collide
    pairs += [(600, "bax"), (601, "abx"), (602, "abx"), (603, "xab")]
    assert found_copies(make_docs(pairs), bases=(1, 1, 1)) == plain_copies(pairs)


def test_hot_group_of_copies(make_docs, spark):
    pairs = [(i, "same words here " if i % 3 else f"text {i}") for i in range(3000)]
    assert found_copies(make_docs(pairs).repartition(13)) == plain_copies(pairs)
    kept = exact.drop_copies(make_docs(pairs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, _, k, _ in plain_copies(pairs) if k)


# manifest


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """Root, and for each leaf the runs and places on the way up."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, a in enumerate(at):
            ways[i].append((a % 16, runs[a // 16]))
        at, level = [a // 16 for a in at], [sha("".join(r)) for r in runs]
    return level[0], ways


def plain_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        leaf = sha("".join(map(coded, r)))
        i, text = r[0], r[4]
        change = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text) if change else text
        by[r[1]].append((i is not None, i or 0, leaf, sha("".join(map(coded, (*r[:4], lowered))))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[s])]) for s in order]
    root, over = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, ways), above in zip(order, trees, over):
        for (known, i, leaf, claim), way in zip(sorted(by[s]), ways):
            path, folded = way + above, claim
            for place, run in path:
                folded = sha("".join([*run[:place], folded, *run[place + 1 :]]))
            proof = sha("".join(x for place, run in path for j, x in enumerate(run) if j != place))
            out.append((i if known else None, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string"


def found_manifest(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    monkeypatch.setattr(merkle, "table", lambda *_: df.repartition(5))
    return sorted((tuple(r) for r in merkle.op11_merkle(spark, "").collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [300, 1, 0, 16], [1, 1], [4200, 3]])
def test_manifest_of_whole_tables(spark, monkeypatch, sizes):
    rows = [(j * 10_000 + i, f"s{j}", "en", i, f"Text {i} Of {j}") for j, n in enumerate(sizes) for i in range(n)]
    assert found_manifest(spark, rows, monkeypatch) == plain_manifest(rows)


def test_manifest_of_awkward_rows(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"é{i % 23}", None if i % 3 else "de", None if i % 4 else i, [None, "", "Äbc DEF", "A" * 50_000][i % 4]) for i in range(120)]
    rows += [(5, "é5", "en", 1, "twice")] * 3 + [(None, "é5", "en", 1, "no id"), (None, "é5", None, None, None), (None, None, None, None, None)]
    assert found_manifest(spark, rows, monkeypatch) == plain_manifest(rows)
    assert found_manifest(spark, [], monkeypatch) == []


def test_many_sources_make_a_deep_tree_over_them(spark, monkeypatch):
    rows = [(i, f"source {i % 300:03d}", "en", 1, f"T{i}") for i in range(700)]
    assert found_manifest(spark, rows, monkeypatch) == plain_manifest(rows)


def test_stored_runs_hash_to_the_next_level(spark):
    rows = [(i, "a", "en", i, f"text {i}", None) for i in range(600)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    stored = {(r["part"], r["level"], r["run"]): [bytes(x).hex() for x in r["nodes"]] for r in made.nodes().collect()}
    for (part, level, run), nodes in stored.items():
        above = stored.get((part, level + 1, run // 16))
        assert above is None or above[run % 16] == sha("".join(nodes))


# fill in the middle


def plain_fim(key, text, every=None):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = sha(f"7:{'' if key is None else key}")
    h1, h2, _, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return key, len(lines), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return key, len(lines), form, len(p), len(m), sha(out), sha(text)


def test_fim_of_awkward_rows(spark, monkeypatch, make_docs, awkward):
    long = "".join(f"línea {i} 日本\n" if i % 5 else "\n" for i in range(30_000))
    pairs = [*awkward, (30, long), (31, "a<M>b\nc"), (32, "\r\n\n x y\n"), (33, "\n" * 500), (34, "🙂\n" * 129), (35, "<P"), (36, "\x00\n\x00")] + [(100 + i, "é\n" * i + "end") for i in range(140)]
    monkeypatch.setattr(fim, "table", lambda *_: make_docs(pairs))
    got = sorted((tuple(r) for r in fim.op13_fim(spark, "").collect()), key=str)
    assert got == sorted((plain_fim(*p) for p in pairs), key=str)
    assert fim.fill_in_middle(make_docs([])).count() == 0


@pytest.mark.parametrize("every, block", [(1, 7), (3, 5), (64, 1 << 16), (1000, 11)])
def test_checkpoints_find_every_line(every, block):
    data = "".join(f"ü{i}\n" * (i % 3) + "\n" for i in range(200)).encode() + "last é".encode()
    lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
    index = fim.Checkpoints.of(data, every, block)
    assert index.n == len(lines) and len(index.units) <= len(lines) // every + 1
    for unit in range(len(lines) + 1):
        before = b"".join(lines[:unit])
        assert index.find(unit) == (len(before), len(before.decode()))


def test_rates_choose_forms(make_docs):
    df = make_docs([(i, f"one {i}\ntwo\nthree\n") for i in range(400)])
    forms = collections.Counter(r["form"] for r in fim.fill_in_middle(df, rate=40, spm_rate=25).collect())
    assert 200 < forms["plain"] < 280 and forms["psm"] > forms["spm"] > 10
    made = fim.fill_in_middle(df, rate=40).select(fim.restore(F.col("output"), F.col("form")).alias("t"))
    assert sorted(r["t"] for r in made.collect()) == sorted(f"one {i}\ntwo\nthree\n" for i in range(400))
