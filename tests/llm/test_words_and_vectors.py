"""Operators 11 to 13 against brute-force versions."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cratewise.llm import alignment, forest, queries, spelling

JSON, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def one_edit(a: str, b: str) -> bool:
    """By trying all edits of the longer one."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b is not None and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(str((w, form[w], root(w), n, len(near[w]), words.get(form[w]))) for w, n in words.items())


def found_variants(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in spelling.variants(df).collect())


def misspelled(seed, docs=60):
    draw = random.Random(seed)
    base = ["government", "governments", "colour", "color", "aaaaaa", "éclairs", "ÀÉÎõüÿ", "analyse", "analyze", "prefixing", "thething", "x" * 30]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(80):
            w = draw.choice(base[: 1 + int(len(base) * draw.random())])
            if draw.random() < 0.3:
                at = draw.randrange(len(w) + 1)
                w = draw.choice([w[:at] + draw.choice("abé") + w[at:], w[:at] + w[at + 1 :], w[:at] + draw.choice("abé") + w[at + 1 :]])
            words.append(w.upper() if draw.random() < 0.2 else w)
        rows.append((i * 3 - 20, draw.choice([" ", "-", "\n", "7"]).join(words)))
    return rows


@pytest.mark.parametrize("tile", [128, 5])
def test_spelling(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    rows = misspelled(tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found_variants(df)
    assert got == brute_variants(rows) and len(got) > 60
    assert sum("None, None)" not in x and x.count("None") == 0 for x in got) > 10


def test_spelling_in_long_chains(spark):
    """Each form is twice as frequent as its variant, along a chain of edits."""
    chain = ["aaaaabbbb"[: 5 + n] for n in range(5)]
    rows = [(n, " ".join([w] * (3 * 2**n))) for n, w in enumerate(chain)]
    rows = [r for r in rows if all(crc32(f"{r[0]}:{w}".encode()) % 97 for w in chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_variants(df) == brute_variants(rows) and {r.root for r in spelling.variants(df).collect()} == {chain[-1]}


def test_spelling_on_odd_rows(spark, odd, empty):
    extra = spark.createDataFrame([(None, "alpha alphb alpha alphb alphb " + " ".join(["y" * 9000, "y" * 8999 + "z"] * 3), None)], "doc_id long, text string, word string")
    df = odd.select("doc_id", "text", F.lit("w").alias("word")).unionByName(extra)
    assert found_variants(df) == brute_variants([(r.doc_id, r.text) for r in df.collect()])
    assert spelling.variants(empty).count() == 0 and spelling.variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_one_edit_by_prefix_and_suffix():
    draw = random.Random(3)
    words = np.array(sorted({"".join(draw.choice("ab") for _ in range(draw.randint(3, 6))) for _ in range(200)}))
    zeros = np.zeros(len(words), int)
    found = {}
    for side in (0, 1):
        for length in range(3, 8):
            at, count, _ = spelling.compare(words, zeros, zeros, zeros + side, zeros + length, zeros, zeros > 0)
            for k, c in zip(at.tolist(), count.tolist(), strict=True):
                found[words[k]] = found.get(words[k], 0) + c
    assert found == {w: n for w in words.tolist() if (n := sum(one_edit(w, v) for v in words.tolist()))}


def brute_alignment(rows):
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    letters = {chr(c): c for c in shown} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in shown)}
    links, lines = [], []
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(n)) for n in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(n)[3:5], 16)]) if b.is_byte(n) else b.id_to_piece(n).replace("▁", " ").encode() for n in ids_b]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(x) for x in own]).astype(int).tolist() for own in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        group = lambda ids, ends, low, high: ",".join(str(n) for n, e in zip(ids, ends, strict=True) if low < e <= high)
        shown_groups = ";".join(f"{group(ids_a, ends_a, low, high)}|{group(ids_b, ends_b, low, high)}" for low, high in zip([0, *cuts], cuts, strict=False))
        own = [(ids_a[ends_a.index(c)], ids_b[ends_b.index(c)]) for c in cuts]
        links.append(own)
        lines.append([doc_id, len(ids_a), len(ids_b), len(cuts), len(own), hashlib.sha256(shown_groups.encode()).hexdigest() if ids_a else ""])
    count = Counter(x for own in links for x in own)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(str((*line[:5], sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), line[5])) for line, own in zip(lines, links, strict=True))


def found_alignment(df):
    return sorted(str(tuple(r)) for r in alignment.align(df, JSON, PIECES)[0].collect())


ODD_TEXTS = [" lead", "trail ", "  two  spaces ", "\n", " ", "▁ mark", "a▁b", "tab\tand\n\n lines", "漢字 かな 🙂🙂 é", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ ﬀ ²", "x\x00y", "é é", "a b　c d"]


@pytest.mark.parametrize("held", [1_000_000, 40])
def test_alignment(spark, odd, empty, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD", held)
    monkeypatch.setattr(alignment, "STRETCH", 7)
    draw = random.Random(4)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(100 + n, t) for n, t in enumerate(ODD_TEXTS)]
    rows += [(200 + n, "".join(draw.choice("abc de fgh  ing the\n.,漢é🙂'S") for _ in range(draw.randint(1, 200)))) for n in range(60)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, a int, row int").repartition(3)
    assert found_alignment(df) == brute_alignment(rows)
    assert alignment.align(empty, JSON, PIECES)[0].count() == 0


def test_pairs_of_all_documents(spark):
    rows, pairs = alignment.align(spark.createDataFrame([(1, "the cat the dog"), (2, "the the")], "doc_id long, text string"), JSON, PIECES)
    assert pairs.agg(F.sum("n")).first()[0] == rows.agg(F.sum("n_links")).first()[0] == 6 and pairs.agg(F.max("n")).first()[0] == 4


def test_lockstep_equals_sets():
    draw = np.random.default_rng(5)
    for _ in range(50):
        sizes = draw.integers(1, 300, draw.integers(1, 9))
        base = np.concatenate([[0], np.cumsum(sizes)])
        ends = [np.concatenate([np.append(np.sort(draw.choice(np.arange(1, s), draw.integers(0, s), replace=False)), s) + b for s, b in zip(sizes, base, strict=False)]) for _ in range(2)]
        first = np.searchsorted(ends[0], base[:-1], "right")
        a, b = alignment.merged(*ends, first)
        assert (ends[0][a] == np.intersect1d(*ends)).all() and (ends[1][b] == ends[0][a]).all()


def brute_nearest(rows, k=10):
    own = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for i, q in own:
        if i % 100 == 0:
            best = {}
            for j, v in own:
                if j != i and len(v) == len(q):
                    best[j] = min(best.get(j, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
            out += [(i, rank + 1, j, d) for rank, (d, j) in enumerate(sorted((d, j) for j, d in best.items())[:k])]
    return sorted(out)


def found_nearest(df):
    return sorted(tuple(r) for r in forest.nearest(df, F.col("vec_id") % 100 == 0).collect())


def test_nearest_is_exact_in_one_leaf(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=5).astype(np.float32).tolist()) for i in range(0, 900, 20)]
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(15)] + [(7, None), (8, []), (9, [0.0] * 5), (10, [1.0, None, 2.0, 3.0, 4.0]), (11, [float("nan")] * 5), (12, [float("inf")] * 5), (None, same), (13, [1.0, 2.0]), rows[0], rows[0]]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, at int, score string").repartition(3)
    got, want = found_nearest(df), brute_nearest([r for r in rows if r[0] != 13])
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-14)
    assert found_nearest(df.limit(0)) == [] and len(found_nearest(df.where("vec_id IN (0, 20, 40)"))) == 2
    assert found_nearest(df.where("vec_id % 100 > 0")) == []


def test_nearest_recall_in_many_leaves(spark, monkeypatch):
    """Clustered vectors, a third of them equal, in many leaves and blocks."""
    for name, value in (("LEAF", 40), ("BLOCK", 30), ("PROBES", 20)):
        monkeypatch.setattr(forest, name, value)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * draw.normal(size=16)).tolist() if i % 3 else [1.0] * 16) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = found_nearest(df), brute_nearest(rows)
    found = {x[:3:2] for x in got}
    assert len(got) == len(want) and sum(x[:3:2] in found for x in want) >= 0.9 * len(want)
    of = {x[:3:2]: x[3] for x in want}
    assert all(abs(of[x[:3:2]] - x[3]) < 1e-12 for x in got if x[:3:2] in of)
    assert {x[:3] for x in got if x[0] % 3 == 0} == {x[:3] for x in want if x[0] % 3 == 0}


def test_the_queue_opens_near_leaves_first():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 8))
    trees = forest.Forest.grow(x, 4)
    leaves = trees.leaves(x)
    trees.counted(np.stack([np.bincount(leaves[:, t], minlength=16) for t in range(len(trees.trees))]))
    order = list(next(trees.opened(x[:1])))
    assert order[: len(trees.trees)] == sorted(enumerate(leaves[0].tolist())) and len(set(order)) == 16 * len(trees.trees)


def test_recall_of_the_query(spark):
    """The registered query against brute force over its whole table."""
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op13_nearest_vectors(spark, folder).collect())
    want = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()])
    assert [x[:3] for x in got] == [x[:3] for x in want]
