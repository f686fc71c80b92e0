import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, value string, part string"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) for _ in range(24)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = [*line, line[0], line[0], line[1].upper(), line[2] + " one", line[3].replace(" ", "\n\t ")]
    for i in range(4, 10):  # edited copies, some near the threshold
        words = line[i].split()
        for j in range(0, len(words), 9 + 12 * (i % 3)):
            words[j] = "zz"
        out.append(" ".join(words))
    out += [f"{line[11]} {passage} {line[12]}", f"{line[13]} {passage}", passage, f"é {passage}", "", " \n\t ", "one", "one two", "one two three four five", "á" * 3000, "x y \x1c z", "a  b\n\nc"]
    return out


def frame(spark, values, start=0):
    rows = [(start + i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t), "x", "y", "z", "p") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [*texts(), None]).cache()


@pytest.fixture(scope="module")
def given():
    return [*texts(), None]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, lower):
    text = text or ""
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(values, percent, lower):
    sets = [shingle_set(t, lower) for t in values]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))], [len(s) for s in sets]


def test_words_split_as_the_pattern_does(given):
    from quarrymill.llm.text import slices

    for limit in (1, 50, 1 << 20):
        got = [[s.word(j).decode() for j in range(s.first[i], s.first[i + 1])] for s in slices(pa.array(given, pa.string()), limit=limit) for i in range(s.hi - s.lo)]
        assert got == [WORDS.findall(t or "") for t in given]


def test_near_duplicates(spark, docs, given):
    from quarrymill.llm.circulant import near_duplicates

    for percent in (80, 85):
        parts, sizes = brute_components(given, percent, True)
        got = {r["doc_id"]: r for r in near_duplicates(docs, percent).collect()}
        assert [got[i]["component_id"] for i in range(len(given))] == parts
        assert [got[i]["n_shingles"] for i in range(len(given))] == sizes
        assert all(got[i]["kept"] == (parts[i] == i) for i in got)
    assert near_duplicates(empty(spark)).count() == 0


def test_near_links_of_universal_minhash(spark, docs, given):
    from quarrymill.llm.minhash import near_links

    parts, _ = brute_components(given, 80, False)
    got = {r["doc_id"]: r["component_id"] for r in near_links(docs).collect()}
    assert [got[i] for i in range(len(given))] == parts


def test_members_without_a_link_to_the_pivot_are_compared_in_blocks(spark, monkeypatch):
    from quarrymill.llm import near
    from quarrymill.llm.circulant import near_duplicates

    monkeypatch.setattr(near, "CROSS", 4)
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(60)]
    values = []
    for i in range(14):  # a ring of edits: neighbours are similar, others less so
        words = list(base)
        for j in range(i, i + 5):
            words[(j * 4) % 60] = f"e{j}"
        values.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, values), 50, rows=2, bands=192).collect()}
    assert [got[i] for i in range(len(values))] == brute_components(values, 50, True)[0]


def test_rows_without_id_and_repeated_rows(spark):
    from quarrymill.llm.circulant import near_duplicates

    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (None, 0, None, True), (None, 2, None, True)], key=str)


def test_texts_of_one_id_that_differ(spark):
    from quarrymill.llm.circulant import near_duplicates

    rows = [(4, "a b c d e f"), (4, "u v w x y z"), (7, "a b c d e f"), (9, "u v w x y z"), (9, None), (3, "")]
    got = sorted({tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()})
    assert got == [(3, 3, True), (4, 4, True), (7, 4, False), (9, 4, False), (9, 9, True)]


def test_a_dense_group_gives_rows_in_proportion(spark):
    """Copies that are near the threshold to each other: links are many times their number, rows are not."""
    from quarrymill.llm import near

    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    sets, part = [], np.arange(120)
    for i in range(120):
        words = [w if rng.random() < 0.97 else f"e{i}x{j}" for j, w in enumerate(base)]
        sets.append(np.unique(np.array([hash(tuple(words[j : j + 5])) & (2**63 - 1) for j in range(96)], np.uint64)))
    every = np.arange(120)
    linked = [(a, b) for a in range(120) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))]
    found = near.joining(sets, part, every, every, True, 70)
    assert len(linked) > 3 * 120 > len(found)
    assert near.joining(sets, part, every[:60], every[60:], False, 70)

    def groups(pairs):
        up = list(range(120))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    assert groups(found) == groups(linked)


def test_a_sieve_lets_all_pass_that_are_asked_for(spark):
    from quarrymill.llm.shared import sift

    rows = spark.range(0, 20000).withColumnRenamed("id", "doc_id")
    asked = rows.where("doc_id % 97 = 5")
    got = {r[0] for r in sift(rows, "doc_id", asked).collect()}
    assert got >= set(range(5, 20000, 97)) and len(got) < 4000
    assert sift(rows, "doc_id", rows.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    from quarrymill.llm.components import components

    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 199), (199, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark, docs, given):
    from quarrymill.llm.minhash import fingerprints

    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    values = [t or "" for t in given]
    assert len(got) == len(values)
    for i, t in enumerate(values):
        after = values[(i + 1) % len(values)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingle_set(t, False), shingle_set(edited, False)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i]["near_edited"] - true) < 0.2
    assert got[0]["fingerprint"] == got[24]["fingerprint"] == got[25]["fingerprint"]
    assert fingerprints(empty(spark)).count() == 0
    assert fingerprints(frame(spark, ["only one here"])).first()["near_next"] == 1.0


def test_fingerprints_query_links_documents(spark, given, tmp_path):
    from quarrymill.llm.minhash import op1_minhash_fingerprints

    frame(spark, given).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op1_minhash_fingerprints(spark, str(tmp_path)).collect()}
    parts, _ = brute_components(given, 80, False)
    assert [got[i]["component_id"] for i in range(len(given))] == parts
    assert [got[i]["kept"] for i in range(len(given))] == [p == i for i, p in enumerate(parts)]
    # a repeated doc_id: the component is that of the text
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u v"), (None, "a b c d e f"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/x/documents.parquet")
    found = op1_minhash_fingerprints(spark, f"{tmp_path}/x").collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"], r["component_id"] or 0, r["kept"]) for r in found if r["doc_id"] != 7) == [(0, 11, 0, True), (1, 11, 1, True), (8, 0, 8, True)]
    assert sorted((r["component_id"], r["kept"]) for r in found if r["doc_id"] == 7) == [(1, False), (7, True)]


def brute_cut(values, length):
    first, out = {}, []
    for d, t in enumerate(values):
        words = WORDS.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first.setdefault(tuple(words[i : i + length]), d) < d:
                gone[i : i + length] = [True] * length
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [13, 50])
def test_substrings(spark, docs, given, length):
    from quarrymill.llm.substring import cut

    got = {r["doc_id"]: r for r in cut(docs, length).collect()}
    for i, want in enumerate(brute_cut(given, length)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_words"]) == want
        assert WORDS.findall(got[i]["kept_text"] or "") == WORDS.findall(want[2])
        assert sum(b - a for a, b in got[i]["spans"]) == want[1]
        assert got[i]["score"] == "x" and (got[i]["kept_text"] is None) == (given[i] is None)
        if not want[1]:
            assert got[i]["kept_text"] == given[i]
    assert cut(empty(spark), length).count() == 0


def test_prints_that_collide_decide_nothing(spark, docs, given):
    """With prints of three bits nearly all windows collide; words decide all the same."""
    from quarrymill.llm.substring import cut

    want = brute_cut(given, 13)
    got = {r["doc_id"]: r for r in cut(docs, 13, bits=3).collect()}
    for i in range(len(given)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_words"]) == want[i]


def test_extension_compares_words():
    from quarrymill.llm.substring import extend

    words = [b"w%d" % i for i in range(30)]
    other = [b"x", *words[3:20], b"y"]
    prints = np.array([7 if p == 8 else p + 100 for p in range(26)], np.int64)

    class Fixed:
        def __init__(self, s, length, bits):
            self.doc, self.at = np.zeros(len(other) - length + 1, int), np.arange(len(other) - length + 1)

        def prints(self):
            return np.array([7 if q in (0, 6) else -q for q in self.at], np.int64)

    from quarrymill.llm import substring

    kept, substring.Windows = substring.Windows, Fixed
    try:  # one seed: the match grows to words 3 to 20 from it, past a window of the same print and other words
        ok, odd = extend(words, prints, [b" ".join(other)], set(), 5)
    finally:
        substring.Windows = kept
    assert np.flatnonzero(ok).tolist() == list(range(3, 16)) and not len(odd)


def test_substrings_of_odd_tables(spark):
    from quarrymill.llm.substring import cut

    passage = " ".join(f"p{i}" for i in range(20))
    long = " ".join(f"q{i % 977}x{i}" for i in range(40000))
    rows = [(3, passage, "a"), (3, passage, "a"), (3, "a " + passage, "b"), (None, passage, "c"), (9, f"z {passage} y", "d"), (9, None, "e"), (7, long, "f"), (8, "s " + long, "g"), (5, "", "h")]
    frame_ = spark.createDataFrame(rows, "doc_id long, text string, `_odd` string").withColumnRenamed("_odd", "spans")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in cut(frame_, 13).collect())
    assert got == [(0, 20, 0), (3, 20, 0), (3, 20, 0), (3, 21, 0), (5, 0, 0), (7, 40000, 0), (8, 40001, 40000), (9, 0, 0), (9, 22, 20)]


def test_packing_boundaries_are_optimal():
    from itertools import combinations

    from quarrymill.llm.packing import boundaries

    rng = np.random.default_rng(1)
    for _ in range(20):
        m, b = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        sizes = np.sort(rng.choice(np.arange(0, 60), m, replace=False))
        counts = rng.integers(1, 20, m)
        ends, pad = boundaries(sizes, counts, sizes * counts, b)

        def padding(ends, sizes=sizes, counts=counts):
            return sum(int(n) * int(min(e for e in ends if e >= s) - s) for s, n in zip(sizes, counts))

        best = min(padding([*c, sizes[-1]]) for k in range(min(b, m)) for c in combinations(sizes[:-1], k))
        assert pad == best == padding(ends) and len(ends) <= b
    assert boundaries(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 3) == ([], 0)


def test_packing(spark, docs, given):
    from quarrymill.llm.packing import lengths, pack

    got = pack(lengths(docs), 3, 128).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, len(WORDS.findall(t or ""))) for i, t in enumerate(given)]
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["boundary"] and r["padding"] == r["boundary"] - r["n_tokens"]
        batches.setdefault((r["bucket"], r["batch"]), []).append((r["slot"], r["boundary"]))
    for rows in batches.values():
        assert sorted(s for s, _ in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0][1] <= 128
    assert pack(lengths(empty(spark))).count() == 0
    long = spark.createDataFrame([(1, 10**7), (2, None), (3, 5)], "doc_id long, n_tokens long")
    assert {r["doc_id"]: r["batch"] for r in pack(long, 2, 64).collect()}.keys() == {1, 2, 3}


def test_packing_boundaries_are_lengths_that_occur(spark):
    from quarrymill.llm.packing import pack

    long = spark.createDataFrame([(1, 20001), (2, 20001), (3, 9001), (4, 5)], "doc_id long, n_tokens long")
    assert {r["doc_id"]: (r["boundary"], r["padding"]) for r in pack(long, 3).collect()} == {1: (20001, 0), 2: (20001, 0), 3: (9001, 0), 4: (5, 0)}


def test_hilbert_neighbours(spark):
    from pyspark.sql import functions as F

    from quarrymill.llm.hilbert import hilbert_index

    for n, bits in ((2, 3), (3, 2), (3, 1)):
        dims = [F.expr(f"cast(shiftright(id, {bits * i}) & {2**bits - 1} as int)").alias(f"d{i}") for i in range(n)]
        rows = spark.range(2 ** (n * bits)).select(*dims).select("*", hilbert_index([F.col(f"d{i}") for i in range(n)], bits).alias("h")).collect()
        rows.sort(key=lambda r: r["h"])
        assert [r["h"] for r in rows] == list(range(len(rows)))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(spark, docs, given):
    from quarrymill.llm.hilbert import shards

    got = {r["doc_id"]: r for r in shards(docs).collect()}
    assert len(got) == len(given)
    by = {}
    for i, t in enumerate(given):
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        by.setdefault(got[i]["shard"], []).append(got[i])
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    ends = [(min(r["hilbert"] for r in by[s]), max(r["hilbert"] for r in by[s])) for s in range(16)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert shards(empty(spark)).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in shards(frame(spark, ["a", None, "a"])).collect()) == [(0, 0), (1, 0), (2, 0)]
    hot = spark.range(300).selectExpr("id % 3 as doc_id", "'t' as text", "'en' as lang", "'s' as source")
    assert sorted(r["n"] for r in shards(hot).groupBy("shard").agg({"slot": "count"}).withColumnRenamed("count(slot)", "n").collect()) == [18] * 4 + [19] * 12


def test_rollup(spark):
    from quarrymill.llm.rollup import Rollup
    from quarrymill.llm.shared import new_path

    book = Rollup(spark, new_path(spark, "rollup"))
    assert book.totals().count() == 0
    kind = "op string, source string, lang string, version string, n_tokens long, old_tokens long"
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "de", "v1", None, None)], kind)
    assert book.commit("one", first) and not book.commit("one", first)
    second = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10), ("insert", "a", "en", "v2", 3, None), ("delete", "a", "en", "v2", 3, None)], kind)
    assert book.commit("two", second)
    assert {tuple(r) for r in book.totals().collect()} == {("a", "en", "v1", 1, 12), (None, "de", "v1", 1, 0)}
    with pytest.raises(Exception, match="unknown op"):
        book.commit("bad", spark.createDataFrame([("what", "a", "en", "v1", 5, None)], kind))
    assert book.committed() == ["one", "two"] and book.totals().count() == 2
    with pytest.raises(ValueError):
        book.commit("../x", first)
    # two writers of one batch: the second finds the name taken when it renames
    first.groupBy("source", "lang", "version").count().write.parquet(f"{book.root}/_draft-x")
    assert not book._put(f"{book.root}/_draft-x", "one") and book.totals().count() == 2
    before = {tuple(r) for r in book.totals().collect()}
    book.compact()
    assert book.committed() == ["one", "two"] and {tuple(r) for r in book.totals().collect()} == before
    assert not book.commit("one", first) and book.commit("three", first)
    book.compact()
    assert book.committed() == ["one", "three", "two"] and ("a", "en", "v1", 3, 27) in {tuple(r) for r in book.totals().collect()}


def test_rollup_query_against_plain_counts(spark, tmp_path):
    from collections import Counter

    from quarrymill.llm.bpe import public_vocabulary
    from quarrymill.llm.rollup import _encoding, op6_token_rollup

    values = [*texts(), None, texts()[0]]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(values)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    encoding = _encoding(*public_vocabulary())
    docs, tokens, seen = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        if (text or "") in seen:
            continue
        seen.add(text or "")
        for version, n in (("words-1", len(WORDS.findall(text or ""))), ("byte_bpe_50k-1", len(encoding.encode_ordinary(text or "")))):
            docs[source, lang, version] += 1
            tokens[source, lang, version] += n
    assert {tuple(r) for r in op6_token_rollup(spark, str(tmp_path)).collect()} == {(*k, docs[k], tokens[k]) for k in docs}


def test_shards_on_disk_keep_every_row(spark, tmp_path):
    from quarrymill.llm.hilbert import write_shards

    rows = [(None, "a b", "en", "x"), (None, "a b", "de", "x"), (None, None, None, None), (1, "c", "en", "y"), (1, "c", "en", "y"), (2, "d " * 500, "fr", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    write_shards(docs, f"{tmp_path}/s", count=3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [2, 2, 2]


def test_votes_against_a_plain_vote(spark):
    from quarrymill.llm.quality import VOTERS, features, fit

    rows = np.concatenate([x for _, x in features(pa.array([t for t in texts() if t.strip()], pa.string()))])
    labels = (np.arange(len(rows)) % 3 == 0).astype(float)
    model = fit(rows, labels, 0.4)
    got = model.score(rows)
    share = labels.mean()
    for i, v in enumerate(model.latent(rows)):
        near = [float(v @ w) for w in model.vectors]
        best = sorted(range(len(near)), key=lambda j: (-np.float32(near[j]), j))[:VOTERS]
        weight = {j: max(near[j], 0.0) ** 8 * (0.4 / share if labels[j] else 0.6 / (1 - share)) for j in best}
        want = (sum(w for j, w in weight.items() if labels[j]) + 0.4e-6) / (sum(weight.values()) + 1e-6)
        assert abs(got[i] - want) < 1e-3


def test_token_counts(spark, docs, given):
    from quarrymill.llm.bpe import public_vocabulary
    from quarrymill.llm.rollup import _encoding, counts

    encoding = _encoding(*public_vocabulary())
    got = {r["doc_id"]: r for r in counts(docs, *public_vocabulary()).collect()}
    for i, t in enumerate(given):
        assert (got[i]["words"], got[i]["tokens"]) == (len(WORDS.findall(t or "")), len(encoding.encode_ordinary(t or "")))


def test_bpe(given):
    from quarrymill.llm.bpe import Piece, public_vocabulary, vocabulary
    from quarrymill.llm.rollup import _encoding

    bpe, theirs = vocabulary(*public_vocabulary()), _encoding(*public_vocabulary())
    rng = random.Random(2)
    letters = " \n\t\x1c\x85 'sdtrevemll123abcABCéñ日本😀́.,!?$-_"
    cases = [t or "" for t in given] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["etaoin" * 40, "<|endoftext|>", "日本" * 50]
    for t in cases:
        want = theirs.encode_ordinary(t)
        assert bpe.encode(t) == want
        assert bpe.decode(want) == t.encode()
        assert bpe.decimal(want).decode() == " ".join(map(str, want))
    raw = b"interoperability"
    piece = Piece(bpe)
    for i in range(len(raw)):
        piece.append(raw[i : i + 1])
        assert piece.ids() == theirs.encode_ordinary(raw[: i + 1].decode())
    for _ in range(60):
        at = rng.randint(0, len(piece.raw))
        piece.edit(at, rng.randint(0, 5), bytes(rng.choices(b"abcdefgh", k=rng.randint(0, 4))))
        assert piece.ids() == theirs.encode_ordinary(piece.raw.decode()) and b"".join(bpe.bytes_of[r] for r in piece.ids()) == piece.raw


def test_bpe_query(spark, docs, given):
    from quarrymill.llm.bpe import encoded, public_vocabulary

    got = {r["doc_id"]: r for r in encoded(docs, *public_vocabulary()).collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(given))
    assert all(got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, got[i]["ids"])).encode()).hexdigest() for i in got)
    assert encoded(empty(spark), *public_vocabulary()).count() == 0


def test_warc(spark):
    from quarrymill.llm.warc import round_trip

    big = "<p>" + "é\r\n\r\nWARC/1.1 x" * 20
    values = [big, "small", "small", None, "", big, big + " ", "\x00" * 99, "y" * 100, "y" * 100]
    rows = [(10 - i, None if i == 3 else f"http://x/{i} ü", t, "clash") for i, t in enumerate(values)]
    got = {r["page_id"]: r for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, _digest string").repartition(3)).collect()}
    assert len(got) == len(values)
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        first = min(p for p, _, h, _ in rows if (h or "") == (html or "")) if len(raw) >= 100 else page
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == page else "revisit", None if first == page else first)
        assert (got[page]["payload_bytes"], got[page]["payload_digest"], got[page]["record_type"], got[page]["refers_to"]) == want
        assert got[page]["payload"] == (raw if first == page else b"")
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_keeps_rows_without_page_id(spark, tmp_path):
    import compare

    from quarrymill.llm.queries import oracle_sql
    from quarrymill.llm.warc import op9_warc_round_trip, round_trip

    rows = [(None, "u", "a" * 200), (None, None, "a" * 200), (5, "u", "a" * 200), (None, "u", "b" * 200), (None, "u", "b" * 200), (None, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0, len(r["payload"])) for r in round_trip(df).collect())
    assert got == sorted([(0, 200, "revisit", 5, 0)] * 2 + [(5, 200, "response", 0, 200)] + [(0, 200, "response", 0, 200)] * 2 + [(0, 0, "response", 0, 0)])
    sf = "/root/testdata/sf0.001"
    assert compare.of_spark(op9_warc_round_trip(spark, sf)) == compare.of_duck(oracle_sql()["op9_warc_round_trip"], sf)


def test_normaliser_reads_any_split_of_the_stream():
    import gzip

    from quarrymill.llm import warc

    raw = [warc.record(i, "http://a", f"body {i}".encode() * 500 * i, 1, "d", None) for i in range(5)]
    for body in (gzip.compress(b"".join(raw)), b"".join(gzip.compress(r) for r in raw)):
        target, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(body), target, index) == 5
        import json

        lines = [json.loads(x) for x in index.getvalue().splitlines()]
        assert [zlib.decompress(target.getvalue()[x["offset"] : x["offset"] + x["length"]], 31) for x in lines] == raw
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(raw[1][:-9])), io.BytesIO(), io.BytesIO())


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(base[i % 60] + rng.standard_normal(16) * (0.15 if i >= 60 else 0)) for i in range(240)]
    rows += [rows[0] + rng.standard_normal(16) * 0.02 for _ in range(40)] + [rows[5] * 3, rows[5], np.zeros(16), np.full(16, np.nan)]
    return [(i, [float(x) for x in np.float32(r)], None if i == 7 else i % 2) for i, r in enumerate(rows)] + [(900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [1.0], None)]


@pytest.mark.parametrize("size", [1000, 60])
def test_flat_graph(spark, size):
    from quarrymill.llm.flat_graph import audit_recall, near_duplicates

    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = near_duplicates(df, size=size).cache()
    got = {r["vec_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    usable = [(i, np.array(v, float) / np.linalg.norm(v), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    there = {i: {j for j, w, m in usable if j != i and m == label and v @ w >= 0.93} for i, v, label in usable}
    found = sum(got[i]["n_links"] for i in there)
    assert 0.9 * sum(map(len, there.values())) <= found <= sum(map(len, there.values()))
    assert all(got[i]["n_links"] <= len(there.get(i, ())) for i in got)
    assert all(got[i]["component_id"] == i and got[i]["kept"] and not got[i]["n_links"] for i in got if not there.get(i))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    a, b = audit_recall(df, out, every=10)
    assert b and a >= 0.9 * b
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("whole", [8192, 500])
def test_flat_graph_counts_all_links_of_a_group_far_larger_than_a_shard(spark, monkeypatch, whole):
    from quarrymill.llm import flat_graph

    monkeypatch.setattr(flat_graph, "WHOLE", whole)
    rng = np.random.default_rng(6)
    x = rng.standard_normal(16) + rng.standard_normal((3000, 16)) * 0.12
    x[0] = x[1]
    x[2990:] = [v for w in rng.standard_normal((5, 16)) for v in (w, w * 2 + 0.01)]  # pairs
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    there = ((unit @ unit.T) >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in flat_graph.near_duplicates(df, size=20).collect()}
    assert [got[i] for i in range(3000)] == there.tolist()


def quality_rows():
    rng = random.Random(6)
    out = []
    for i in range(300):
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        out.append((i, "!! ".join(words).upper() if bad else " ".join(words), 0 if bad else 1))
    return [*out, (300, "", 1), (301, None, 0)]


def test_quality(spark):
    from quarrymill.llm.quality import scored, train

    rows = quality_rows()
    df = spark.createDataFrame([(i, t, "c") for i, t, _ in rows], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, None), (5000, 1)], "doc_id long, quality int")
    model = train(df, labels)
    got = {r["doc_id"]: r for r in scored(df, model).collect()}
    assert len(got) == len(rows)
    held = [(i, q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 5 == 0 and t]
    assert held and all(got[i]["predicted"] == q for i, q in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert abs(got[300]["score"] - model.prior) < 1e-9 and abs(got[301]["score"] - model.prior) < 1e-9
    assert scored(df.limit(0), model).count() == 0
    none = train(df, labels.limit(0))
    assert {r["score"] for r in scored(df, none).collect()} == {0.5}


def test_model_ignores_held_out_labels(spark):
    from quarrymill.llm.quality import train

    rows = quality_rows()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    a, b = (train(df, spark.createDataFrame(x, "doc_id long, quality int")) for x in ([(i, q) for i, _, q in rows], turned))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def test_training_holds_few_copies_of_its_sample(spark):
    import tracemalloc

    from quarrymill.llm.quality import DIMS, train

    rng = random.Random(3)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'BAD!'}{rng.randrange(300)}" for _ in range(40)), i % 2) for i in range(800)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8).cache()
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").cache()
    assert df.count() == labels.count() == 800
    tracemalloc.start()
    try:
        model = train(df, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.vectors) > 600
    assert peak < 2.5 * len(model.vectors) * DIMS * 4  # rows in half floats, once in floats, and small parts


def test_features_are_packed_without_loss():
    from quarrymill.llm.quality import DIMS, features, packed, unpack

    rng = np.random.default_rng(2)
    rows = [*np.concatenate([x for _, x in features(pa.array([*texts(), None], pa.string()))])]
    for filled in (0, 1, DIMS // 2 - 1, DIMS // 2, DIMS // 2 + 1, DIMS):
        row = np.zeros(DIMS, np.float32)
        row[rng.permutation(DIMS)[:filled]] = rng.uniform(0.1, 9, filled)
        rows.append(row)
    rows.append(np.full(DIMS, 1e-9, np.float32))  # zeros as half floats
    for row in rows:
        raw, out = packed(row), np.zeros(DIMS, np.float16)
        unpack(raw, out)
        assert len(raw) <= 2 * DIMS and np.array_equal(out, row.astype(np.float16))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(55))
    good = [" ".join(word() for _ in range(80)) for _ in range(60)]
    good[10] = good[3]
    good[11] = good[4] + " end"
    good[20] = f"{good[20]} {passage} tail"
    good[22] = f"{good[22]} {passage}"
    bad = ["!! ".join(word() for _ in range(80)).upper() for _ in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*good, *bad])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(P.STAGES[:-1]):
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before
        docs.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        if n == 0:
            assert set(left) == set(range(60))
        if n == 1:
            assert set(left) == set(range(60)) - {10, 11}
    assert passage in left[20] and left[22].strip() == good[22].replace(passage, "").strip()
    assert all(left[i] == good[i] for i in left if i != 22)
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == set(left)


def test_pipeline_bands_miss_no_more_than_those_of_op8(spark, monkeypatch):
    import corpus_pipeline
    from quarrymill.llm import circulant

    used = {}
    plain = circulant.near_duplicates

    def watched(docs, percent, **kw):
        used.update({"percent": percent, "rows": circulant.ROWS, "bands": circulant.BANDS} | kw)
        return plain(docs, percent, **kw)

    monkeypatch.setattr(circulant, "near_duplicates", watched)
    corpus_pipeline.drop_near_duplicates(spark, empty(spark), "")
    missed = (1 - (used["percent"] / 100) ** used["rows"]) ** used["bands"]
    assert missed <= (1 - 0.85**circulant.ROWS) ** circulant.BANDS


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    found = e.queries()
    assert all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)) and "pipeline" in found
