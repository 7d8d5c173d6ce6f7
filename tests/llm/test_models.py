"""Operators with learned or random parts: exact halves, held-out quality, balance, alignment."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelloom.llm import language, leaks, lm, mixing, queries, tokens, threads
from tests.llm import brute
from tests.llm.conftest import pairs


def trained(d):
    return d is None or zlib.crc32(str(d).encode()) % 7 != 2


@pytest.mark.parametrize("name", ["odd", "small"])
def test_lm_base(name, request):
    docs = request.getfixturevalue(name)
    own = pairs(docs)
    texts = [[*brute.word_list(brute.lower(t)), " "] for _, t in own]
    counts = Counter(w for (d, _), ws in zip(own, texts) if trained(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, _), ws in zip(own, texts))
    held = language.held_out(F.col("doc_id"), 7, 2)
    # a small head, so that many tokens meet their counts in the join
    found = lm.score_texts(docs, ~held, outcomes=20, head_size=40).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)



@pytest.mark.parametrize("size", [1, 7, 50, 300, 5000])
def test_head(spark, size):
    """The head is as large as it may be, and the classes above the last one are whole."""
    rng = np.random.default_rng(size)
    n = {int(h): int(k) for h, k in zip(rng.integers(-(1 << 62), 1 << 62, 2000) * 2, rng.zipf(1.5, 2000).clip(max=10**9))}
    counts = spark.createDataFrame(list(n.items()), "h long, n long").repartition(4)
    head = lm.head_of(counts, outcomes=5, size=size)
    found = dict(zip(head.hash.view(np.int64).tolist(), head.count.tolist()))
    assert len(found) == min(size, len(n)) and found.items() <= n.items()
    assert (head.total, head.distinct) == (sum(n.values()), len(n))
    level = {h: np.floor(np.log2(k) * 8) for h, k in n.items()}
    assert min(level[h] for h in found) >= max((level[h] for h in n if h not in found), default=0)
    assert head.outcomes == min(5, len(found))


def test_lm_is_normalised():
    head = lm.Head(np.arange(6, dtype=np.uint64), np.array([9, 8, 7, 3, 2, 1]), np.array([0, 1, 2, -1, -1, -1]), 40, 10)
    model = lm.fresh(head, 4)
    score = lm.Scorer(model)
    for one, two in ((4, 4), (0, 3), (2, 1)):
        every = np.arange(4)
        assert (10 ** score(np.full(4, one), np.full(4, two), every)).sum() == pytest.approx(1, abs=1e-5)


def test_lm_learns():
    """Outcomes that follow from the one before become likely, others do not."""
    head = lm.Head(np.arange(8, dtype=np.uint64), np.full(8, 100), np.arange(8), 800, 8)
    trainer = lm.Trainer(lm.fresh(head, 8), lm.noise_of(head), 1)
    rng = np.random.default_rng(0)
    for _ in range(300):
        one = rng.integers(0, 8, 512)
        trainer.batch(one, rng.integers(0, 8, 512), (one + 1) % 8)
    score = lm.Scorer(trainer.model)
    one = np.arange(8)
    assert (10 ** score(one, one[::-1].copy(), (one + 1) % 8)).mean() > 0.5


def test_lm_tells_rare_tokens_apart(spark):
    """Tokens far behind the most frequent ones have vectors of their own: the word that follows each is known."""
    rng = random.Random(8)
    lines = [f"a{k} b{k}" for k in range(800)] * 60
    rng.shuffle(lines)
    rows = [(i, " ".join(lines[i * 100 : i * 100 + 100])) for i in range(len(lines) // 100)]
    rows += [(10_000 + k, f"a{k} b{k}") for k in range(800)] + [(20_000 + k, f"a{k} b{(k + 400) % 800}") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    score = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("doc_id") < 10_000).collect()}
    better = [score[10_000 + k] > score[20_000 + k] for k in range(800)]
    assert sum(better) > 700


@pytest.mark.parametrize("part_tokens", [lm.PART_TOKENS, 100_000])
def test_lm_beats_unigrams_in_any_layout(spark, part_tokens):
    """The same scores from 1, 4 and 16 tasks, in one part or several, and better ones than counts alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 7, 2)
    found = []
    for layout in (docs.coalesce(1), docs.repartition(4), docs.repartition(16, "doc_id")):
        scores = lm.score_texts(layout, ~held, part_tokens=part_tokens).withColumn("held", held).collect()
        found.append({r["doc_id"]: r["score"] for r in scores})
        own = [r for r in scores if r["held"]]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
    assert found[0] == pytest.approx(found[1], rel=1e-9) and found[0] == pytest.approx(found[2], rel=1e-9)


def test_lm_score_is_the_tokens_own():
    """A token has the same chance alone, and among others in any order."""
    head = lm.Head(np.arange(400, dtype=np.uint64), np.arange(900, 500, -1), np.arange(400), 300_000, 500)
    model, rng = lm.fresh(head), np.random.default_rng(4)
    model.context *= 8
    score = lm.Scorer(model)
    one, two, target = (rng.integers(0, n, 5000) for n in (402, 402, 401))
    want = score(one, two, target)
    for some in (rng.permutation(5000), rng.permutation(5000)[:1234], np.arange(7), np.array([42])):
        assert score(one[some], two[some], target[some]) == pytest.approx(want[some], rel=1e-12)


@pytest.mark.parametrize("spread", [3, 40, 4000])
def test_lm_sums(spread):
    """Every row once, with the sum and number of its values, many or few."""
    rng = np.random.default_rng(spread)
    rows = (rng.pareto(1, 3000) * spread).astype(np.int64) % 5000
    values = rng.normal(size=(3000, 5)).astype(np.float32)
    found, sums, n = lm._sums(rows, values)
    assert sorted(found.tolist()) == sorted(set(rows.tolist()))
    for k, row in enumerate(found):
        assert n[k] == (rows == row).sum() and sums[k] == pytest.approx(values[rows == row].sum(axis=0), rel=1e-4, abs=1e-4)


def test_lm_models_are_added_in_steps(small, monkeypatch):
    """Many parts, added up three at a time, give the model that one sum gives."""
    held = language.held_out(F.col("doc_id"), 7, 2)
    whole = {r["doc_id"]: r["score"] for r in lm.score_texts(small, ~held, part_tokens=5_000).collect()}
    monkeypatch.setattr(lm, "FAN", 3)
    steps = {r["doc_id"]: r["score"] for r in lm.score_texts(small, ~held, part_tokens=5_000).collect()}
    assert steps == pytest.approx(whole, rel=1e-4)


def test_lm_token_hashes():
    words = [b"", b"a", b"aa", b"b", b"ab", b"ba", "\u00e9".encode(), b"x" * 5000, b"x" * 4999]
    plain = lm.token_hashes(pa.array(words, pa.binary()))
    assert len(set(plain.tolist())) == len(words)
    assert (lm.token_hashes(pa.array(words[::-1], pa.large_binary()))[::-1] == plain).all()
    assert len(lm.token_hashes(pa.array([], pa.binary()))) == 0


def test_language_grams(small):
    letters = language.Letters()
    texts = [t for _, t in pairs(small)][:40] + ["", "  ", "É é\tß--ab", "日本 語", "a"]
    from labelloom.llm.blocks import _block

    block = _block(list(range(len(texts))), [t.encode() for t in texts], {}, False)
    doc, gram, count = language.document_grams(block, letters)
    for d, text in enumerate(texts):
        want = Counter()
        for w in "".join(c.lower() if c.isalpha() else " " for c in text).split():
            padded = [1, *map(ord, w), 1]
            want.update((c,) for c in padded[1:-1])
            want.update(tuple(padded[i : i + 2]) for i in range(len(padded) - 1))
            want.update(tuple(padded[i : i + 3]) for i in range(len(padded) - 2))
        found = {}
        for g, n in zip(gram[doc == d].tolist(), count[doc == d].tolist()):
            key = []
            while g:
                key.insert(0, g & 0x1FFFFF)
                g >>= 21
            found[tuple(key)] = n
        assert found == dict(want)


def test_language(spark, odd, nothing):
    found = queries.op6_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.filter("held_out").join(docs, "doc_id")
    right = held.filter("lang = lang_pred").count() / held.count()
    assert right > 0.95
    model = language.fit(docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language.fit(nothing)
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(nothing, model).collect() == []


def test_language_distance(spark):
    """Places, ties and the largest distance, by hand."""
    docs = spark.createDataFrame([(1, "aab", "x"), (2, "bbc", "y"), (3, None, "x"), (4, "ab", None)], "doc_id int, text string, lang string")
    rows = [r.asDict() for r in language.profiles(docs, 3).collect()]
    top = {(r["lang"], r["place"]): r["gram"] for r in rows}
    assert top["x", 0] == ord("a") and top["x", 1] == ord("b") and top["x", 2] == (1 << 21) | ord("a")
    model = language.Model(rows, 3)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert got[1]["lang_pred"] == "x" and got[1]["score"] == 1 and got[4]["lang_pred"] == "x"
    assert got[3]["lang_pred"] == "und"


def test_targets(spark):
    def plain(sizes):
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        goal, fixed = 1.5 * sum(sizes.values()), {}
        while True:
            rest = [s for s in names if s not in fixed]
            left = goal - sum(fixed.values())
            share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            over = [s for s in rest if share[s] > 2 * sizes[s]]
            if not over:
                return {**fixed, **share}
            fixed |= {s: 2 * sizes[s] for s in over}

    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 5)) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 900)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = plain(sizes)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_mix(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mix(docs)
    rows = first.collect()
    assert len(rows) == docs.count()
    assert Counter(rows) == Counter(mixing.mix(docs.repartition(5)).collect())
    taken, most = Counter(), defaultdict(int)
    goal = {r["source"]: r["target"] for r in rows}
    for r in rows:
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        whole = r["target"] / r["source_size"]
        assert math.floor(whole) <= r["copies"] <= math.ceil(whole) or r["size"] == 0
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
    assert sum(abs(taken[s] - goal[s]) for s in goal) < 0.02 * sum(goal.values())
    found = mixing.mix(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d, len(brute.word_list(t))) for d, t in pairs(odd))
    assert mixing.mix(nothing).collect() == []
    assert not [x for x in ("Python", "Arrow", "Pandas") if x in first._jdf.queryExecution().toString()]


def test_rounding_keeps_chances(spark):
    """Over many seeds, a document's mean is its chance, and words are kept at every level of the tree."""
    rows = [("s", i, 10 + i % 7, 0.3) for i in range(400)] + [("t", 1, 5, 0.5)]
    df = spark.createDataFrame(rows, "source string, doc_id long, size long, p double").cache()
    total = Counter()
    for seed in range(12):
        found = mixing.round_fractions(df, 401, seed * 100).collect()
        assert len(found) == 401
        words = sum(r["size"] * r["up"] for r in found if r["source"] == "s")
        assert abs(words - 0.3 * sum(r[2] for r in rows[:-1])) <= 16
        total.update({r["doc_id"]: r["up"] for r in found if r["source"] == "s"})
    assert sum(total.values()) / 12 / 400 == pytest.approx(0.3, abs=0.01)
    assert max(total.values()) < 11 and len(total) == 400


def test_rounding_of_equal_rows(spark, monkeypatch):
    """Rows that nothing tells apart are settled in lots; words are kept to one document, in any layout."""
    rows = spark.range(100_000).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 3 == 1, F.lit("b")).alias("source"),
        F.when(F.col("id") % 1000 == 2, F.lit("one two three four")).otherwise(F.lit("one two three")).alias("text"),
    )
    found = mixing.mix(rows)
    table = found.groupBy("source", "size", "copies").count().collect()
    assert sum(r["count"] for r in table) == 100_000
    for source in ("a", "b", None):
        own = [r for r in table if r["source"] == source]
        goal = found.filter(F.col("source").eqNullSafe(F.lit(source))).first()["target"]
        assert abs(sum(r["size"] * r["copies"] * r["count"] for r in own) - goal) <= 4
    other = mixing.mix(rows.repartition(11)).groupBy("source", "size", "copies").count().collect()
    assert Counter(map(tuple, other)) == Counter(map(tuple, table))
    monkeypatch.setattr(mixing, "LOT", 3)
    few = spark.createDataFrame([("s", 1, 7, 0.4)] * 100 + [("s", None, 5, 0.4)] * 50 + [("s", 2, 1, 0.4)], "source string, doc_id long, size long, p double")
    got = Counter((r["doc_id"], r["size"]) for r in mixing.round_fractions(few, 151, 3).collect())
    assert got == {(1, 7): 100, (None, 5): 50, (2, 1): 1}
    words = sum(r["size"] * r["up"] for r in mixing.round_fractions(few, 151, 3).collect())
    assert abs(words - 0.4 * (700 + 250 + 1)) <= 7


def test_targets_of_many_sources(spark):
    """Sizes over nine decades, all full, and no sources."""
    df = spark.range(2000).select(F.format_string("s%05d", "id").alias("source"), F.pow(F.lit(10.0), F.col("id") % 900 / 100).cast("long").alias("source_size"))
    rows = mixing.targets(df).collect()
    total = sum(r["source_size"] for r in rows)
    assert sum(r["target"] for r in rows) == pytest.approx(1.5 * total)
    level = {w: {r["target"] / w for r in rows if (5, 2, 1)[int(r["source"][1:]) % 3] == w and r["target"] < 2 * r["source_size"]} for w in (5, 2, 1)}
    assert len({round(x, 3) for own in level.values() for x in own}) == 1
    assert all(r["target"] <= 2 * r["source_size"] for r in rows)
    assert [r["target"] for r in mixing.targets(df, share=3.0).collect()] == [2 * r["source_size"] for r in mixing.targets(df, share=3.0).collect()]
    assert mixing.targets(df.limit(0)).collect() == []


MODEL = queries.VOCABULARY


def reference(bytes_too):
    from tokenizers import Tokenizer, models

    own = tokens.Vocabulary.from_model(MODEL)
    pieces = [("<unk>", 0.0), *own.pieces]
    if bytes_too:
        pieces += [(f"<0x{i:02X}>", -1e6) for i in range(256)]
    made = tokens.Vocabulary(tuple(pieces), bytes_too)
    return Tokenizer(models.Unigram(pieces, 0, bytes_too)), made


@pytest.mark.parametrize("bytes_too", [False, True])
@pytest.mark.parametrize("name", ["odd", "small"])
def test_token_counts(name, bytes_too, request):
    docs = request.getfixturevalue(name)
    tokenizer, made = reference(bytes_too)
    known = {}

    def count(word):
        if word not in known:
            known[word] = len(tokenizer.encode(tokens.MARK + word).tokens)
        return known[word]

    want = Counter((d, len(brute.word_list(t)), sum(map(count, brute.word_list(t)))) for d, t in pairs(docs))
    assert Counter(map(tuple, tokens.count_tokens(docs, made).collect())) == want


def test_token_ties(spark, nothing):
    """Equal scores: the piece that begins first; unknown neighbours: one token."""
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁ab", -3.0)]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, False))
    counter = tokens.Counter(tokens.Vocabulary(tuple(pieces)))
    rng = random.Random(1)
    words = [tokens.MARK + "".join(rng.choice("abab?é") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    assert counter.count(words).tolist() == [len(tokenizer.encode(w).tokens) for w in words]
    empty = tokens.Vocabulary(())
    assert tokens.Counter(empty).count(["▁ab", "▁"]).tolist() == [1, 1]
    assert tokens.count_tokens(nothing, empty).collect() == []


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_align():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item = rng.integers(0, 5, rng.integers(1, 12))
        passages = [rng.integers(0, 5, rng.integers(1, 25)) for _ in range(4)]
        score, first, end = leaks.align(item, passages)
        assert score.tolist() == [smith_waterman(item, p) for p in passages]
        for p, s, a, z in zip(passages, score, first, end):
            if s:
                assert smith_waterman(item, p[a:z]) == s


def test_leaks(spark, odd, nothing):
    """Exact and edited copies in other text are found, with their places; clean documents are not."""
    base = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{base}/benchmark.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    rng = random.Random(4)
    some = [(r["item_id"], r["text"].split()) for r in items.orderBy("item_id").limit(40).collect()]
    filler = [f"w{i}" for i in range(5000)]
    rows = []
    for i, words in some:
        if len(words) < 30:
            continue
        edited = [rng.choice(filler) if rng.random() < 0.15 else (w.upper() if w.isascii() else w) for w in words]
        del edited[7]
        rows.append((i, " ".join(rng.sample(filler, 300)) + " " + ", ".join(edited) + "\n" + " ".join(rng.sample(filler, 200))))
        rows.append((1000 + i, " ".join(rng.sample(filler, 400))))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    found = leaks.find_leaks(made, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, d) for d, _ in rows if d < 1000}
    assert all(295 <= r["first_word"] <= 310 and r["end_word"] > r["first_word"] + 9 for r in found)
    clean = leaks.without_leaks(made, items)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows if d >= 1000}
    # whole items in documents, by plain search
    exact = {(d, r["item_id"]) for r in items.collect() for d, t in pairs(docs) if r["text"] in t}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect()}
    own = spark.createDataFrame([(1, None), (None, "one two three"), (7, "two words"), (5, "Two, words!"), (6, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(odd, own).collect()}
    assert got == {(4, 5), (None, 5)}
    assert leaks.without_leaks(odd, own).count() == odd.count() - 2
    # an item without id is one as any other
    more = own.union(spark.createDataFrame([(None, "FULL: " + "x y " * 700), (None, "one"), (9, "one")], own.schema))
    got = Counter((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(odd, more).collect())
    assert got == Counter({(4, 5): 1, (None, 5): 1, (3, 9): 2, (9, None): 1})
    assert leaks.without_leaks(odd, more).count() == odd.count() - 5
    assert leaks.without_leaks(odd, own).columns == odd.columns
    assert leaks.find_leaks(nothing, own).collect() == [] and leaks.find_leaks(odd, own.limit(0)).collect() == []
    assert leaks.without_leaks(odd, own.limit(0)).count() == odd.count()


def test_leaks_without_common_runs(spark, monkeypatch):
    """Every copy that scores enough is found: with each third word replaced, words put between, and edits at random."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(40)
    rng = random.Random(6)
    filler = [f"w{i}" for i in range(5000)]
    rows, want = [], set()
    for r in items.collect():
        words = leaks._plain(np.array([0]), [r["text"].encode()]).data.tobytes().decode().split()
        copies = [
            [rng.choice(filler) if k % 3 == 2 else w for k, w in enumerate(words)],
            [x for w in words for x in (w, rng.choice(filler))],
            [w for k, w in enumerate(words) if k % 2 == 0],
            *([rng.choice(filler) if rng.random() < share else w for w in words] for share in (0.3, 0.4, 0.45)),
            words[: len(words) // 2] + rng.sample(filler, len(words) // 2) + words[len(words) // 2 :],
        ]
        for made in copies:
            score = smith_waterman(words, made) / (2 * len(words))
            rows.append((len(rows), " ".join(rng.sample(filler, 60) + made + rng.sample(filler, 60))))
            if score >= leaks.MIN_SCORE:
                want.add((rows[-1][0], r["item_id"]))
    assert len(want) > 150 and {d % 7 for d, _ in want} >= {0, 1, 3, 4}
    made = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(leaks, "HITS", 50)
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(made, items).collect()}
    assert found == want
    assert {r["doc_id"] for r in leaks.without_leaks(made, items).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    base = "/root/testdata/sf0.01"
    items, docs = spark.read.parquet(f"{base}/benchmark.parquet"), spark.read.parquet(f"{base}/documents.parquet")
    whole = Counter((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect())
    monkeypatch.setattr(leaks, "ITEM_BYTES", 10_000)
    assert Counter((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect()) == whole
    # equal items, in any number of blocks: one row for their class, and one for each other id
    again = items.union(items.select(F.col("item_id") + 100_000, F.concat(F.lit("- "), "text", F.lit(" !")))).union(items)
    rows = leaks.leak_table(docs, again).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows if r["same_as"] is None) == whole
    ids = [r["item_id"] for r in items.collect()]
    assert Counter((r["doc_id"], r["item_id"], r["same_as"]) for r in rows if r["same_as"] is not None) == Counter((None, i + 100_000, i) for i in ids)
    stay = {r["doc_id"] for r in leaks.without_leaks(docs, again).collect()}
    assert stay == {d for d, _ in pairs(docs)} - {d for d, _ in whole}


def test_one_thread_leaves_products_right():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (300, 40)), rng.integers(0, 9, (40, 200))
    assert threads.one_thread() in (True, False)
    assert (a.astype(float) @ b.astype(float) == a @ b).all()
