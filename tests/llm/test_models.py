"""Learned and approximate operators: held-out accuracy, brute force over small tables, defined corner cases."""

import collections
import random

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import bagminhash, chroma, langid, lines, toxicity
from statloom.llm.common import held_out
from statloom.llm.components import components

WORDS = {
    "en": "the of and house water river stone under light morning friend garden window letter people".split(),
    "de": "der die und haus wasser fluss stein unter licht morgen freund garten fenster brief leute".split(),
}


def text_of(rnd, lang, n=40):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def test_language_of_held_out_texts(spark, make_docs):
    rnd = random.Random(2)
    docs = make_docs([(i, text_of(rnd, "en")) for i in range(60)]).unionByName(make_docs([(100 + i, text_of(rnd, "de")) for i in range(60)], "de"))
    odd = make_docs([(200, None), (201, ""), (202, "12 !!"), (None, text_of(rnd, "de")), (203, text_of(rnd, "en", 40_000))], None)
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    scored, names = langid.predict(docs.unionByName(odd), model)
    rows = scored.select(F.col(names[0]).alias("id"), F.col(names[2]).alias("lang"), "lang_pred", F.col("score").alias("s")).collect()
    assert all(r["lang_pred"] == r["lang"] for r in rows if r["lang"])
    by = {r["id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (200, 201, 202, None, 203)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r["s"] <= 1 for r in rows) and by[200]["s"] == 0
    nothing, _ = langid.predict(docs, langid.train(docs.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_code_lengths_are_exact():
    """Against a plain walk down the context tree, and they form a (sub-)probability."""
    text = "abracadabra abracadabra"
    gram, n = np.unique(langid._grams([text])[0], return_counts=True)
    model = langid.Model(["x"], np.zeros(len(gram), int), gram, n)
    counts = collections.Counter()
    data = b"\n" * langid.ORDER + text.encode()
    for i in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER + 1):
            counts[data[i - k : i], data[i]] += 1

    def bits(context, symbol):
        total = 0.0
        for k in range(langid.ORDER, -1, -1):
            own = {s: c for (ctx, s), c in counts.items() if ctx == context[len(context) - k :]}
            if own and symbol in own:
                return total + np.log2(sum(own.values()) + len(own)) - np.log2(own[symbol])
            if own:
                total += np.log2(sum(own.values()) + len(own)) - np.log2(len(own))
        return total + 8

    probe = b"\n" * langid.ORDER + "cadabxra é".encode()
    wanted = sum(bits(probe[i - langid.ORDER : i], probe[i]) for i in range(langid.ORDER, len(probe)))
    assert model.score(["cadabxra é"])[0, 0] == pytest.approx(wanted)


def test_toxicity_and_identity_terms(spark, make_docs):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [*text_of(rnd, "en", 30).split(), *(["idiot", "scum"][: rnd.randint(1, 2)] if toxic else [])]
        if toxic and rnd.random() < 0.6 or rnd.random() < 0.05:
            words.append("muslims")
        elif rnd.random() < 0.3:
            words.append("christians")
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame, marks = make_docs(docs), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame.where(~held_out(F.col("doc_id"))), marks)
    plain = toxicity.train(frame.where(~held_out(F.col("doc_id"))), marks, penalty=0.0)
    gap = lambda m: abs(m.weights.get("muslims", 0) - m.weights.get("christians", 0))
    assert gap(model) < gap(plain) / 2
    scored, names = toxicity.score(frame, model)
    truth = dict(labels)
    held = scored.where(held_out(F.col(names[0]))).select(names[0], "predicted").collect()
    assert held and all(truth[i] == p for i, p in held)
    odd, _ = toxicity.score(make_docs([(1, None), (2, ""), (3, "!!")]), model)
    assert len({r["score"] for r in odd.select(F.col("predicted").alias("score")).collect()}) == 1
    kept = toxicity.drop_toxic(frame, marks)
    assert kept.columns == frame.columns and 295 <= kept.count() <= 305
    assert toxicity.train(frame, marks.limit(0)).logits(["x"]) == [-40.0]


def test_fit_minimises_the_penalised_loss():
    """Against the loss written out text by text; a text that has both terms only loses one."""
    rnd = random.Random(9)
    x = [np.array(sorted({rnd.randrange(4), rnd.randrange(4)}), np.int64) for _ in range(80)]
    y = np.array([float(0 in r or rnd.random() < 0.3) for r in x])
    swaps = [(i, a, 1 - a) for i, r in enumerate(x) for a in (0, 1) if a in r]
    assert any({0, 1} <= set(r.tolist()) for r in x)

    def loss(w, c, l2, penalty):
        z = lambda words: c + sum(w[j] for j in words)
        own = np.mean([np.log1p(np.exp(-z(r) if t else z(r))) for r, t in zip(x, y)])
        swapped = np.mean([(z((set(x[i].tolist()) - {a}) | {b}) - z(set(x[i].tolist()))) ** 2 for i, a, b in swaps])
        return own + l2 / 2 * float(w @ w) + penalty * swapped

    gaps = []
    for penalty in (0.0, 2.0):
        w, c = toxicity.fit(x, y, swaps, 4, 0.01, penalty, steps=3000)
        least = loss(w, c, 0.01, penalty)
        for j in range(4):
            for move in (-0.05, 0.05):
                assert loss(w + move * (np.arange(4) == j), c, 0.01, penalty) > least - 1e-7
        gaps.append(abs(w[0] - w[1]))
    assert gaps[1] < gaps[0] / 2


def test_every_telling_word_counts(spark, make_docs):
    """No cap on the vocabulary: 3000 words that mark toxic texts are all learned; rows that repeat an id give one text."""
    docs, labels = [], []
    for i in range(600):
        own = " ".join(f"bad{j}" for j in range(3000)) if i % 2 else "plain text"
        docs += [(i, own), (i, own)]
        labels.append((i, i % 2))
    model = toxicity.train(make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sum(w.startswith("bad") for w in model.weights) == 3000


def test_copies_are_sampled_one_by_one(make_docs, monkeypatch):
    """A text that all rows hold is neither taken whole nor left out: the sample keeps near its size."""
    same = text_of(random.Random(3), "en", 30)
    monkeypatch.setattr(langid, "Model", lambda languages, lang, gram, n: n)
    sampled = langid.train(make_docs([(i, same) for i in range(3000)]), sample_bytes=len(same) * 300).sum() / len(same)
    assert 200 < sampled < 400


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(150):
        base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        w1 = rng.integers(0, 6, len(base))
        w2 = np.where(rng.random(len(base)) < 0.7, w1, rng.integers(0, 6, len(base)))
        h = bagminhash.signatures([(base[w1 > 0], w1[w1 > 0]), (base[w2 > 0], w2[w2 > 0])], 256)
        gaps.append((h[0] == h[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum())
    assert abs(np.mean(gaps)) < 0.008


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_classes(texts, threshold=0.8):
    bags = [dict(zip(*(v.tolist() for v in bagminhash.shingles(t, 5)))) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum(min(c, bags[j].get(s, 0)) for s, c in bags[i].items())
            total = sum(bags[i].values()) + sum(bags[j].values()) - both
            if (texts[i] or "") == (texts[j] or "") or total and both >= threshold * total:
                parent[max(find(parent, i), find(parent, j))] = min(find(parent, i), find(parent, j))
    return [find(parent, i) for i in range(len(texts))]


def near_copies():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(120)]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(120)] = rnd.choice(vocabulary)
            docs.append(" ".join(copy))
    return docs


def test_near_duplicates_equal_brute_force(spark, make_docs, awkward):
    texts = [*near_copies(), *(t for _, t in awkward if t is None or len(t) < 1000)]
    rows = bagminhash.near_duplicates(make_docs(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(brute_classes(texts)))
    assert bagminhash.near_duplicates(make_docs([])).count() == 0


def test_one_row_of_each_class_stays(spark, make_docs, awkward):
    docs = make_docs(awkward)
    kept = bagminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect()) == [(False, i) for i in (1, 3, 5, 6, 7, 8, 9)]


def brute_lines(docs, similarity=0.9, blocks=4, min_words=5):
    occurrences = collections.defaultdict(list)
    for i, text in docs:
        for p, line in enumerate((text or "").split("\n")):
            norm = regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip()
            if norm and norm.count(" ") >= min_words - 1:
                occurrences[norm].append((i, p))
    names = list(occurrences)

    def sim(norm):
        ws = norm.split(" ")
        votes = [sum(xxhash.xxh64_intdigest(w.encode(), 42) >> b & 1 for w in ws) for b in range(64)]
        return sum(1 << b for b in range(64) if votes[b] * 2 > len(ws))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    hashes, parent = [sim(n) for n in names], list(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            a, b = names[i], names[j]
            if (hashes[i] ^ hashes[j]).bit_count() < blocks and distance(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9):
                parent[max(find(parent, i), find(parent, j))] = min(find(parent, i), find(parent, j))
    groups = collections.defaultdict(list)
    for i, n in enumerate(names):
        groups[find(parent, i)] += occurrences[n]
    gone = {x for g in groups.values() for x in sorted(g)[1:]}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def test_fuzzy_lines_equal_brute_force(spark, make_docs):
    rnd = random.Random(9)
    vocabulary = [f"w{i}x" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 60, 150]))] for _ in range(12)]
    docs = []
    for i in range(50):
        own = []
        for _ in range(rnd.randint(0, 4)):
            line = list(rnd.choice(base))
            if rnd.random() < 0.5:
                line[rnd.randrange(len(line))] = rnd.choice(vocabulary)
            own.append(rnd.choice(["{}.", "  {}", "{}"]).format(" ".join(line).upper() if rnd.random() < 0.3 else " ".join(line)))
        docs.append((i, "\n".join(own)))
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, "!!! ???")]
    out = lines.dedup_lines(make_docs(docs))
    assert out.columns == [*make_docs([]).columns, "_n_lines", "_n_removed"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(docs)


def test_crowded_buckets_lose_no_link(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(9999)}x" for _ in range(120)]
    norms = []
    for _ in range(150):
        copy = list(base)
        copy[rnd.randrange(120)] = f"v{rnd.randrange(9999)}"
        norms.append(" ".join(copy))
    distinct = spark.createDataFrame([(i, n) for i, n in enumerate(norms)], "node long, norm string")
    whole = lines.grouped_lines(distinct, 4, 0.9, crowd=10**9)
    thinned = lines.grouped_lines(distinct, 4, 0.9, crowd=4)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, thinned.collect()))


def test_lines_are_linked_by_edit_similarity_alone(spark):
    """Brute force without a SimHash gate, at every length, with words changed and with single characters changed."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    norms, pairs = [], []
    for n in (5, 8, 20, 40, 80):
        for _ in range(16):
            line = [word() for _ in range(n)]
            other = list(line)
            for at in rnd.sample(range(n), max(1, n // 25)):
                other[at] = word()
            typed = list(" ".join(line))
            for at in rnd.sample(range(len(typed)), len(typed) // 20):
                typed[at] = "z"
            norms += [" ".join(line), " ".join(other), "".join(typed)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for i in range(0, len(norms), 3):
        for a, b in ((i, i + 1), (i, i + 2)):
            if distance(norms[a], norms[b]) <= int(0.1 * max(len(norms[a]), len(norms[b])) + 1e-9):
                pairs.append((a, b))
    assert len(pairs) > 100
    distinct = spark.createDataFrame(list(enumerate(norms)), "node long, norm string")
    roots = {r["node"]: r["root"] for r in lines.grouped_lines(distinct, None, 0.9).collect()}
    lost = [(a, b) for a, b in pairs if roots.get(a) is None or roots.get(a) != roots.get(b)]
    assert len(lost) <= len(pairs) // 100
    thinned = {r["node"]: r["root"] for r in lines.grouped_lines(distinct, None, 0.9, crowd=2).collect()}
    assert thinned == roots
    gated = {r["node"]: r["root"] for r in lines.grouped_lines(distinct, 4, 0.9).collect()}
    assert sum(gated.get(a) is None or gated.get(a) != gated.get(b) for a, b in pairs) > len(pairs) // 2


def test_lines_lose_no_link_wherever_edits_stand(spark):
    """As many edits as 0.9 allows, spread evenly so that no two words in a row stay whole, or at random places, at every length."""
    rnd, norms, pairs = random.Random(12), [], []
    word = lambda: "".join(rnd.choice("abcdefghijklmnop𝐚é") for _ in range(rnd.randint(2, 9)))
    for size in (10, 14, 19, 20, 27, 39, 40, 66, 89, 90, 99, 125, 139, 140, 141, 230, 450, 1000):
        for way in range(4):
            line = list(" ".join(word() for _ in range(size))[:size].strip())
            line += ["q"] * (size - len(line))
            edits, other = size // 10, list(line)
            places = rnd.sample(range(size), edits) if way == 3 else [size * (2 * i + 1) // (2 * edits) for i in range(edits)]
            for n, at in enumerate(sorted(places, reverse=True)):
                if way == 1 or (way == 2 and n % 2):
                    del other[at]
                elif way == 2:
                    other.insert(at, "z")
                else:
                    other[at] = "z"
            if len(other) <= size:
                norms += ["".join(line), "".join(other)]
                pairs.append((len(norms) - 2, len(norms) - 1))
    distinct = spark.createDataFrame(list(enumerate(norms)), "node long, norm string")
    roots = {r["node"]: r["root"] for r in lines.grouped_lines(distinct, None, 0.9).collect()}
    assert len(pairs) > 60 and [p for p in pairs if roots.get(p[0]) is None or roots[p[0]] != roots.get(p[1])] == []


def test_joins_of_pieces_are_split_without_loss(spark, monkeypatch):
    """Pieces of many characters go to several joins, each with its share of the rows, and the groups stay the same."""
    rnd, norms = random.Random(13), []
    for size in (12, 45, 120, 160, 300):
        for _ in range(8):
            line = [rnd.choice("abcdefgh 𐚐é") for _ in range(size)]
            other = list(line)
            for i in range(size // 10):
                other[i * 10 + 5] = "z"
            norms += ["x" + "".join(line[1:]), "x" + "".join(other[1:])]
    distinct = spark.createDataFrame(list(enumerate(norms)), "node long, norm string")
    whole, write, joins = lines.grouped_lines(distinct, None, 0.9).collect(), lines.cut, []

    def counted(df, label):
        out = write(df, label)
        if label == "pairs":
            joins.append(out.count())
        return out

    monkeypatch.setattr(lines, "cut", counted)
    monkeypatch.setattr(lines, "_PART", len("".join(norms)) // 4, raising=False)
    monkeypatch.setattr(lines, "_PARTS", 4, raising=False)
    split = lines.grouped_lines(distinct, None, 0.9).collect()
    assert sum(n > 0 for n in joins) >= 4
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole)) and len({r["root"] for r in split}) == len(norms) // 2


def test_strings_are_made_once_and_lose_no_link(spark, monkeypatch):
    """Over all rounds each string of a line is one row of one join, and any edits that 0.9 allows, anywhere, leave a link."""
    rnd, norms, pairs = random.Random(14), [], []
    for i in range(300):
        size = rnd.choice([10, 11, 19, 20, 30, 57, 89, 90, 100, 123, 180, 260, 410])
        line = [rnd.choice("abcdefgh 𐚐é"[: rnd.choice([4, 11])]) for _ in range(size)]
        other, edits = list(line), size // 10
        for _ in range(edits):
            at, way = rnd.randrange(len(other)), rnd.choice("sid")
            other[at : at + (way != "i")] = [] if way == "d" else rnd.choice("abcxyz")
        if line != other and edits <= max(size, len(other)) // 10:
            norms += ["".join(line), "".join(other)]
            pairs.append((norms[-2], norms[-1]))
    monkeypatch.setattr(lines, "_PART", len("".join(norms)) // 5)
    made, strings = [], lines._strings

    def counted(*args):
        made.append(strings(*args).select("node", "place").collect())
        return strings(*args)

    monkeypatch.setattr(lines, "_strings", counted)
    distinct = spark.createDataFrame([(n,) for n in sorted(set(norms))], "norm string").selectExpr("xxhash64(norm) AS node", "norm")
    roots = {r["norm"]: r["root"] for r in lines.grouped_lines(distinct, None, 0.9, crowd=10**9).join(distinct, "node").collect()}
    assert len(pairs) > 250 and [p for p in pairs if p[0] != p[1] and (roots.get(p[0]) is None or roots[p[0]] != roots.get(p[1]))] == []
    rows = [tuple(r) for part in made for r in part]
    assert len(made) > 3 and len(rows) == len(set(rows))
    grid = lines._Grid(0.9, 500)
    want = sum(len(n) - grid.widths[grid.of(len(n))] + 1 for n in set(norms) if len(n) >= 9)
    assert len(rows) == want


def test_lengths_that_may_be_alike_are_in_neighbouring_buckets():
    for similarity in (0.8, 0.9, 0.95):
        grid = lines._Grid(similarity, 3000)
        for n in range(2, 3000):
            edits = int((1 - similarity) * n + 1e-9)
            for k in {grid.of(n), grid.of(n) - 1} if edits else ():
                assert grid.of(n - edits) >= grid.of(n) - 1 and 0 < grid.widths[k] <= n // (edits + 1) and grid.spans[grid.of(n)] * lines._SPANS > n


def test_short_lines_take_part(spark, make_docs, tmp_path):
    """The query and the pipeline's stage remove copies of lines of any length, and fuzzy ones from ten characters."""
    docs = [(1, "Home\n日本語の行です\nread more here"), (2, "home!\n日本語の行です\n\n###"), (3, "kept\nread more hera\n###\n")]
    want = {1: docs[0][1], 2: "\n###", 3: "kept\n###\n"}
    make_docs(docs).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, make_docs(docs), str(tmp_path)).collect()} == want
    assert {r["doc_id"]: r["n_removed"] for r in lines.op3_simhash_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 1}


def test_lines_of_awkward_rows(spark, make_docs, awkward):
    rows = lines.dedup_lines(make_docs(awkward)).collect()
    assert len(rows) == len(awkward)
    assert sorted(r["_n_removed"] for r in rows) == [0] * 10 + [1] or sum(r["_n_removed"] for r in rows) >= 1
    assert lines.dedup_lines(make_docs([])).count() == 0


def test_same_tune_aligns_and_another_does_not(spark):
    rnd = random.Random(1)
    tune = [rnd.choice("do re mi fa so la ti".split()) + str(rnd.randrange(9)) for _ in range(90)]
    other = [rnd.choice("do re mi fa so la ti".split()) + str(rnd.randrange(9)) for _ in range(90)]
    texts = [(100, " ".join(tune)), (1, " ".join(tune)), (2, " ".join(tune[10:])), (3, " ".join(other)), (4, ""), (5, None), (6, "do"), (None, " ".join(tune))]
    heard = chroma.fingerprints(spark.createDataFrame(texts, "id long, text string"), "id", "text", chroma.rendered)
    rows = {r["rec_id"]: r for r in chroma.align(heard, F.col("rec_id") % 100 == 0).collect()}
    assert len(rows) == 8 and rows[100]["class_id"] == rows[1]["class_id"] == 1
    found = {m["class_id"]: m for m in rows[100]["matches"]}
    assert set(found) == {1, 2} and found[1]["bit_errors"] == 0 and found[2]["offset"] == -10
    assert rows[4]["n_prints"] == rows[5]["n_prints"] == 0 and rows[4]["class_id"] is None and rows[1]["matches"] == []
    assert chroma.align(heard.limit(0), F.col("rec_id") % 100 == 0).count() == 0


def test_audio_in_blocks_is_audio_whole(spark):
    pcm = (np.random.default_rng(0).normal(0, 5000, 20_000)).astype("<i2")
    whole, n = chroma.chroma([pcm])
    for cuts in ([1, 2, 511], [512, 1024], [9000, 9001], list(range(0, 20_000, 700))):
        parts, m = chroma.chroma(np.split(pcm, cuts))
        assert n == m == 20_000 and np.array_equal(parts, whole) and len(whole) == -(-(20_000 - chroma.FRAME) // chroma.HOP) + 1
    rows = spark.createDataFrame([(1, bytearray(pcm.tobytes())), (2, None), (3, bytearray(b"x"))], "id long, audio binary")
    got = {r["rec_id"]: (r["n_samples"], r["prints"]) for r in chroma.fingerprints(rows, "id", "audio").collect()}
    assert got[1] == (20_000, chroma.fingerprint(whole).tolist()) and got[2] == got[3] == (0, [])


def test_recall_of_noisy_passages(spark):
    """Against votes of single prints: passages of 40 tones inside other recordings, with single tones changed."""
    rnd = random.Random(5)
    words = [f"n{i}" for i in range(400)]
    line = lambda n: [rnd.choice(words) for _ in range(n)]
    texts = []
    for i in range(40):
        passage = line(80)
        copy = [rnd.choice(words) if rnd.random() < 0.02 else w for w in passage]
        texts += [(i * 100, " ".join(passage)), (i * 100 + 1, " ".join(line(rnd.randrange(6)) + copy))]
    heard = chroma.fingerprints(spark.createDataFrame(texts, "id long, text string"), "id", "text", chroma.rendered).cache()
    prints = {r["rec_id"]: np.array(r["prints"]) for r in heard.collect()}
    got = {r["rec_id"]: {m["class_id"] for m in r["matches"]} for r in chroma.align(heard, F.col("rec_id") % 100 == 0).collect()}
    wanted = caught = 0
    for q in range(0, 4000, 100):
        for c, b in prints.items():
            a = prints[q]
            votes = collections.Counter(o for i, v in enumerate(a) for o in (np.flatnonzero(b == v) - i).tolist())
            n, _, offset = max(((n, -abs(o), o) for o, n in votes.items()), default=(0, 0, 0))
            lo = max(0, -offset)
            size = min(len(a), len(b) - offset) - lo
            if n >= 4 and int(np.bitwise_count((a[lo : lo + size] ^ b[lo + offset : lo + offset + size]).view(np.uint32)).sum()) <= 0.3 * 32 * size:
                wanted, caught = wanted + 1, caught + (c in got[q])
    assert wanted > 60 and caught >= 0.9 * wanted


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(2)
    words = [f"n{i}" for i in range(40)]
    tunes = [[rnd.choice(words) for _ in range(60)] for _ in range(6)]
    texts = [(i * 25, " ".join(rnd.choice(tunes)[rnd.randrange(20) :])) for i in range(40)]
    heard = chroma.fingerprints(spark.createDataFrame(texts, "id long, text string"), "id", "text", chroma.rendered).cache()
    prints = {r["rec_id"]: np.array(r["prints"]) for r in heard.collect()}
    classes = {}
    for i in sorted(prints):
        classes.setdefault(prints[i].tobytes(), i)
    got = {r["rec_id"]: r for r in chroma.align(heard, F.col("rec_id") % 100 == 0).collect()}
    for q in [i for i in prints if i % 100 == 0]:
        wanted = {}
        for c in classes.values():
            a, b = prints[q], prints[c]
            votes = collections.Counter((np.flatnonzero(b == v)[:, None] - i).ravel()[k] for i, v in enumerate(a) for k in range((b == v).sum()))
            if not votes:
                continue
            n, _, offset = max((n, -abs(o), o) for o, n in votes.items())
            lo = max(0, -offset)
            size = min(len(a), len(b) - offset) - lo
            errors = int(np.bitwise_count((a[lo : lo + size] ^ b[lo + offset : lo + offset + size]).view(np.uint32)).sum())
            if n >= 4 and errors <= 0.3 * 32 * size:
                wanted[c] = (offset, n, errors)
        assert {m["class_id"]: (m["offset"], m["votes"], m["bit_errors"]) for m in got[q]["matches"]} == wanted


def test_short_recordings_and_a_common_opening(spark):
    """A passage that all recordings share is looked up at one place, and recordings of four to eight prints are found inside others."""
    rnd = random.Random(8)
    words = [f"n{i}" for i in range(400)]
    line = lambda n: [rnd.choice(words) for _ in range(n)]
    opening, places = line(60), {}
    for many in (60, 120):
        texts = [(i, " ".join(opening + line(20))) for i in range(many)]
        tune = line(70)
        texts += [(1000, " ".join(tune)), (1100, " ".join(tune[20:42])), (1200, " ".join(tune[5:70])), (1001, " ".join(tune[30:52]))]
        heard = chroma.fingerprints(spark.createDataFrame(texts, "id long, text string"), "id", "text", chroma.rendered).cache()
        classes = heard.withColumn("is_query", F.col("rec_id") % 100 == 0).withColumnRenamed("rec_id", "class_id")
        places[many] = chroma._looked_up(classes, 4).where("class_id < 1000").count()
        got = {r["rec_id"]: (r["n_prints"], {m["class_id"]: m["offset"] for m in r["matches"]}) for r in chroma.align(heard, F.col("rec_id") % 100 == 0).collect()}
        assert set(got[0][1]) >= set(range(many))
        assert 4 <= got[1100][0] <= 8 and got[1100][1] == {1000: 20, 1100: 0, 1200: 15}
        assert got[1200][1][1001] == -25 and got[1000][1][1001] == -30
    assert all(n <= 6 * many for many, n in places.items())  # the opening alone holds over 40 pairs a recording
