"""Top-k search, manifest and trie against plain versions, on odd rows and under other layouts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelloom.llm import manifest, topk, turns
from tests.llm.test_exact import rows_of

VECTORS = "vec_id long, embedding array<double>, block int, score string, query_id int"


def plain_top_k(rows, k, every):
    known = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(math.floor(1024 * x)) < 1 << 27 for x in v)
    ]
    out = []
    for n, (q, w) in enumerate(known):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for m, (i, v) in enumerate(known) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], VECTORS)


def found_top_k(df, **options):
    return rows_of(topk.top_k(df, **options), "query_id", "rank", "vec_id", "score")


def test_top_k_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows += [(60 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(0, rows[0][1]), (0, rows[0][1]), (-5, rows[3][1]), (None, rows[1][1]), (95, None), (100, []), (96, [0.5]), (105, [0.1] * 9)]
    rows += [(97, [None] * 6), (110, [float("nan")] * 6), (98, [float("inf")] + [0.0] * 5), (115, [1e9] * 6), (120, [130000.0] * 6)]
    want = plain_top_k(rows, 4, 5)
    for parts in (1, 7):
        assert found_top_k(vectors(spark, rows).repartition(parts), k=4, every=5) == want
    assert not found_top_k(vectors(spark, []))
    assert not found_top_k(vectors(spark, [(0, [1.0])]))
    assert found_top_k(vectors(spark, [(0, [1.0]), (3, [2.0])])) == Counter({(0, 1, 3, 2 << 20): 1})


@pytest.mark.parametrize("shape", ["even", "skewed", "equal", "sparse"])
def test_top_k_over_many_blocks(spark, shape, monkeypatch):
    """Lists that allow an early stop, lists that allow none, and values that are all alike."""
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(4)
    made = {
        "even": rng.normal(0, 0.1, (900, 16)),
        "skewed": rng.pareto(1.5, (900, 5)) - rng.pareto(1.5, (900, 5)),
        "equal": rng.integers(-1, 2, (900, 3)).astype(float),
        "sparse": rng.normal(0, 1, (900, 8)) * (rng.random((900, 8)) < 0.1),
    }[shape]
    rows = [(i, v) for i, v in enumerate(made.tolist())]
    want = plain_top_k(rows, 10, 20)
    blocks = topk.pack(vectors(spark, rows).repartition(3), rows=128)
    assert blocks.count() >= 7
    cells = topk._cells(blocks, topk._queries(blocks, 20), 10).collect()
    best = defaultdict(list)
    for r in cells:
        best[r["query_id"]].append((-r["score"], r["vec_id"]))
    got = Counter((q, n + 1, i, -s) for q, found in best.items() for n, (s, i) in enumerate(sorted(found)[:10]))
    assert got == want


def test_lists_stop_early():
    """With a limit from other blocks few vectors of a block are left to score."""
    rng = np.random.default_rng(0)
    values = np.floor(rng.normal(0, 100, (1024, 8)))
    queries = np.floor(rng.normal(0, 100, (3, 8)))
    scores = queries @ values.T
    limit = np.sort(scores, axis=1)[:, -10].astype(float)
    rows, cols = topk.read_lists(values, queries, np.full(3, -1), limit, 10)
    assert set(zip(*np.nonzero(scores >= limit[:, None]))) <= set(zip(rows, cols))
    assert len(rows) < 3 * 1024 / 4


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(digests):
    """Levels of a tree, and its root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        run = i - i % 16
        path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        i //= 16
    return path


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return sha("".join(map(field, r)))

    by_source = defaultdict(list)
    for d, text, lang, source, n in rows:
        changed = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        by_source[source].append((d is not None, d or 0, leaf((d, source, lang, n, text)), leaf((d, source, lang, n, low if changed else text)), d))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, own, now, d) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = plain_path(trees[s], i) + plain_path(top, at)
            for left, right in path:
                now = sha(left + now + right)
            root = top[-1][0]
            out.append((d, own, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return Counter(out)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check_manifest(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = rows_of(manifest.audit(docs), *MANIFEST)
    assert found == plain_manifest(rows)
    return found


@pytest.mark.parametrize("name", ["odd", "small"])
def test_manifest(name, request):
    found = check_manifest(request.getfixturevalue(name))
    assert name == "odd" or {r[-1] for r in found} == {True, False}


def test_manifest_of_many_levels(spark):
    """A hot source of three levels, sources of one, sixteen and seventeen leaves, many sources, another layout."""
    rows = [(i, f"Text {i}", "en", "hot", i) for i in range(1000)]
    rows += [(i, f"Text {i}", None, s, i) for s, n in (("one", 1), ("run", 16), ("more", 17), (None, 3), ("Ä", 2), ("", 33)) for i in range(n)]
    rows += [(i, "T", "x", f"site{i}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert check_manifest(docs) == check_manifest(docs.repartition(5))


def test_manifest_of_little(nothing, spark):
    assert manifest.audit(nothing).count() == 0
    check_manifest(spark.createDataFrame([(1, None, None, None, None)], nothing.schema[:1].add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")))


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, len(text.encode()), (role, text)))
    own = {c: [x[4] for x in sorted(xs)] for c, xs in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, key in built.items():
        for d in range(len(key) + 1):
            members[key[:d]].append(c)
    children, inner = Counter(), {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in members.items()}
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += inner[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends)))
    return Counter(out)


CONVS = "conv_id long, turn long, role string, text string, key string, depth int, n_convs string, _p int"


def check_trie(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "k", 1, "n", 2) for r in rows], CONVS).repartition(parts)
    found = rows_of(turns.trie(table), *TRIE)
    assert found == plain_trie(rows)
    return found


def test_trie_odd_rows(spark):
    rng = random.Random(2)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "é" * 40])))
    rows += [(None, 1, "user", "lost"), (3, None, "user", "first"), (3, None, None, None), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "a", "tie")]
    rows += [(200, t, "user", "x" * 3000) for t in range(9)] + [(201, 1, None, None)]
    assert check_trie(spark, rows, 1) == check_trie(spark, rows, 6)


def test_trie_of_little(spark):
    assert not check_trie(spark, [])
    assert not check_trie(spark, [(None, 1, "a", "b")])
    check_trie(spark, [(4, 1, "a", "b")])


def test_trie_hot_conversation(spark, monkeypatch):
    """Copies of one long conversation, one of a kind that is longer, and id lists of many pieces."""
    monkeypatch.setattr(turns, "PIECE", 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 200, 5) for t in range(12)]
    rows += [(5_000, t, "user", f"own {t}") for t in range(150)]
    rows += [(c, 0, "user", "turn 0") for c in range(1001, 1100)]
    check_trie(spark, rows)
