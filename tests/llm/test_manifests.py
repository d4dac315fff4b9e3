"""The manifest, the piece coder and the hard negatives against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstream.llm import merkle, negatives, pieces

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, fan):
    """Root and each leaf's (left, right) siblings, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    ways = []
    for p in range(len(leaves)):
        way = []
        for j, nodes in enumerate(levels[:-1]):
            at = p // fan**j
            run = at // fan * fan
            way.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fan])))
        ways.append(way)
    return levels[-1][0], ways


def brute_manifest(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], fan) for g in order}
    root, above = tree([trees[g][0] for g in order], fan)
    out = []
    for g, more in zip(order, above):
        for (has, i, h), way in zip(sorted(groups[g]), trees[g][1]):
            out.append((i if has else None, h, trees[g][0], root, tuple(way + more)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan,nodes,n", [(2, 256, 40), (2, 4, 333), (3, 9, 200), (5, 5, 61), (2, 2, 7)])
def test_manifest(spark, monkeypatch, fan, nodes, n):
    """Ragged ends, lone leaves, null groups and values, equal rows, and trees of several windows."""
    monkeypatch.setattr(merkle, "WINDOW_NODES", nodes)
    r = random.Random(n)
    rows = [(i, r.choice(["a", None]), r.choice(["en", "en", "en", "é", "", None]), r.choice([None, i]), r.choice([None, "", "text é", "1:x"])) for i in range(n)]
    rows += [rows[3], rows[3], (None, None, "en", None, None), (n + 1, "s", "lone", 1, "x" * 100_000)]
    docs = spark.createDataFrame([(*x, 1, "clash", 2) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, `group` string, n int")
    got = merkle.merkle_manifest(docs, COLUMNS, fan=fan).collect()
    assert sorted([(x["doc_id"], x["leaf"], x["subroot"], x["root"], tuple((s["left"], s["right"]) for s in x["steps"])) for x in got], key=repr) == brute_manifest(rows, fan)


def test_manifest_tells_tampering(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'s' AS source", "IF(id % 3 = 0, 'a', 'b') AS lang", "id AS n_chars", "concat('t', id) AS text")
    found = merkle.leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.when(F.col("doc_id") == 77, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.col("text")])
    out = merkle.merkle_manifest(docs, COLUMNS, also={"found": found})
    bad = out.where(merkle.folded(F.col("steps"), F.col("found")) != F.col("root")).collect()
    assert [r["doc_id"] for r in bad] == [77]
    assert merkle.merkle_manifest(docs.limit(0), COLUMNS).count() == 0
    one = merkle.merkle_manifest(docs.limit(1), COLUMNS).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["steps"] == []


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder(model_path):
    return pieces.PieceCoder(model_path)


def odd_texts(coder, n=1500):
    r = random.Random(5)
    out = ["", " ", "   ", "   a", "▁▁▁▁▁▁▁▁ x", "a▁", "\n\n\n", "a\tb\x00c\r\n  d", "é" * 50 + " 日本語テキスト 한국어", "<0x0A> <s> </s> <unk>", "U.S.A., e.g. etc.: x", "\U0001f600   x\x85", "x" * 3000, "日本" * 2000]
    out += ["".join(r.choice("ab ▁\n\té日<0x>/s'.,:!") for _ in range(r.randrange(1, 60))) for _ in range(n)]
    out += ["".join(coder.model.id_to_piece(r.randrange(32000)) for _ in range(20)) for _ in range(n)]
    out += ["".join(chr(r.choice([r.randrange(32, 1500), r.randrange(0x4E00, 0x9FFF), r.randrange(0x10000, 0x10FFFF)])) for _ in range(20)) for _ in range(n)]
    return out


def test_agenda_gives_the_librarys_ids(coder):
    texts = odd_texts(coder)
    ids = [coder.encode(x) for x in coder.normalized(texts)]
    assert ids == coder.model.encode(texts)
    assert [coder.decode(x) for x in ids] == coder.model.decode(ids)


def test_cut_segments_give_what_the_whole_gives(coder):
    """The agenda over a whole text, without cuts, ends in the same ids."""
    for text in coder.normalized(odd_texts(coder, 150)):
        assert coder.merged(text) == coder.encode(text)


def test_decodes_any_ids(coder):
    r = random.Random(6)
    ids = [[r.choice([r.randrange(32000), r.randrange(259), r.randrange(3, 259)]) for _ in range(12)] for _ in range(1500)]
    assert [coder.decode(x) for x in ids] == coder.model.decode(ids)


def test_encode_pieces(spark, documents, odd_rows, coder, model_path, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    rows = odd_rows + [(20, "word " * 30_000 + "\n" + "x" * 50_000), (21, "日本語" * 9000), (22, "a\x00b")]
    got = pieces.encode_pieces(documents(rows), model_path)
    assert got.columns == ["doc_id", "ids", "decoded", "agrees"]
    want = sorted((str(i), coder.model.encode(t or ""), t or "", True) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"], r["agrees"]) for r in got.collect()) == want
    back = pieces.decode_pieces(got.select("doc_id", "ids"), model_path).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encode_pieces(documents([]), model_path).count() == 0


def test_library_stands_where_they_differ(spark, documents, model_path, monkeypatch):
    own = pieces.PieceCoder.encode
    monkeypatch.setattr(pieces.PieceCoder, "encode", lambda self, t: own(self, t)[:-1] if "odd" in t else own(self, t))
    got = {r["doc_id"]: (r["agrees"], r["decoded"]) for r in pieces.encode_pieces(documents([(1, "an odd one"), (2, "even")]), model_path).collect()}
    assert got == {1: (False, "an odd one"), 2: (True, "even")}


def test_words_are_held_against_the_library(coder, model_path):
    """Each new word once, whole texts only where words don't tell; a word that goes wrong is found in every text that has it."""
    fresh = pieces.PieceCoder(model_path)
    texts = ["one two, three.\nfour", "one two, three. four", "two blanks  here", "ends ", " starts", "", "a▁b", "日本 é\x00 <s> one"]
    check = lambda ts: fresh.sure(ts, n := fresh.normalized(ts), [fresh.decode(fresh.encode(x)) for x in n])
    met = []

    class Library:
        def __getattr__(self, name):
            return getattr(coder.model, name)

        def encode(self, held, **more):
            met.extend(held)
            return coder.model.encode(held, **more)

    fresh.model = Library()
    assert check(texts) == [True, True, False, False, False, False, False, True]
    assert len(met) == len(set(met)) and {"one", "two,", "three.\nfour", "日本", "<s>"} <= set(met) and "" not in met
    met.clear()
    assert check(texts[:2] + ["one more"]) == [True] * 3 and met == ["more"]
    fresh.words["six"] = fresh.fresh["six"] = list(coder.model.encode("s ix"))
    assert check(["five six", "five", "s ix"]) == [False, True, True] and check(["six"]) == [False] and fresh.wrong == {"six"}


def test_new_words_are_merged_side_by_side(coder, model_path, monkeypatch):
    """All short words and segments of a batch at once, in blocks of any size, and with their ids from pairs alone."""
    texts = [x for x in odd_texts(coder, 300) if len(x) < 40] + ["aaaaaaa aaaa", "日本 \U0010fffd\x01x\x02", "x" * 47]
    alone = pieces.PieceCoder(model_path)
    for cells in (1 << 18, 64, 1):
        monkeypatch.setattr(pieces, "CELLS", cells)
        fresh = pieces.PieceCoder(model_path)
        normalized = fresh.normalized(texts)
        fresh.learn(normalized)
        with monkeypatch.context() as m:
            m.setattr(fresh, "merged", None)  # no agenda of a single segment
            assert [fresh.encode(x) for x in normalized] == coder.model.encode(texts)
    whole = [x for x in normalized if x and len(x) <= pieces.SHORT]
    got = {x: list(ids) for xs, found in alone.agendas.merged(whole) for x, ids in zip(xs, found)}
    assert got == {x: alone.merged(x) for x in whole}


def test_equal_ranks_are_merged_from_the_left():
    """Pieces of equal ranks, characters that are pieces only with others, and such that are in none."""
    ids = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aa": 4, "cd": 5, "abab": 6}
    agendas = pieces.Agendas(ids, {t: {"ab": 1, "ba": 1, "aa": 1, "cd": 2, "abab": 0}.get(t, 9) for t in ids}, 7, list(range(100, 356)))
    want = {"aba": (2, 0), "bab": (3, 1), "aaab": (4, 2), "abab": (6,), "cda": (5, 0), "ca": (100 + ord("c"), 0), "bzé": (1, 100 + ord("z"), 100 + 0xC3, 100 + 0xA9)}
    assert {x: ids for xs, found in agendas.merged(list(want)) for x, ids in zip(xs, found)} == want


def brute_negatives(rows, every, p, k, window, scale):
    own = [(i, y, [int(np.floor(scale * float(x))) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)]
    heads, out = {}, []
    for i, y, v in own:
        if i % every == 0:
            heads[i] = min(heads.get(i, (y, v)), (y, v))
    for a, (y, v) in heads.items():
        scored = sorted((-sum(s * t for s, t in zip(v, w)), i, z == y) for i, z, w in own if i != a)
        for s, i, _ in [x for x in scored if x[2]][:p]:
            far = [x for x in scored if not x[2] and window[0] * -s <= 100 * -x[0] <= window[1] * -s][:k]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(far, 1)]
    return sorted(out)


def taken(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


SCHEMA = "vec_id long, label int, embedding array<float>, id int, v string, part string, score long"


@pytest.mark.parametrize("block,anchors,size", [(4096, 4096, 1 << 20), (40, 3, 1 << 20), (4096, 4096, 100)])
def test_hard_negatives(spark, monkeypatch, block, anchors, size):
    """Ties, odd rows, vectors of several lengths, and many blocks and groups."""
    for name, value in (("BLOCK_ROWS", block), ("BLOCK_ANCHORS", anchors), ("BLOCK_NUMBERS", size)):
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(7)
    rows = [(i, r.randrange(3), [r.choice([-0.5, 0.1, 0.25, 1.0]) for _ in range(r.choice([20, 20, 20, 3]))]) for i in range(260)]
    rows += [(300, 1, rows[0][2]), (300, 0, rows[1][2]), (301, None, rows[1][2]), (None, 1, rows[1][2]), (400, 1, None), (401, 1, [float("nan")] * 20), (402, 1, [None, 1.0]), (500, 2, []), (600, 9, rows[5][2])]
    df = spark.createDataFrame([(*x, 1, "x", "y", 2) for x in rows], SCHEMA)
    got = taken(negatives.hard_negatives(df, every=20))
    assert got == brute_negatives([(i, y, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows], 20, 5, 10, (30, 90), 256) and len(got) > 400
    assert taken(negatives.hard_negatives(df.limit(0))) == [] and taken(negatives.hard_negatives(df.where("vec_id = 7"))) == []


def test_repeated_vectors_and_normal_ones(spark):
    r = np.random.default_rng(8)
    m = r.normal(size=(1500, 64)) / 8
    m[200:900] = m[200]
    rows = [(i, int(i % 5), [float(x) for x in np.float32(v)]) for i, v in enumerate(m)]
    got = taken(negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")))
    assert got == brute_negatives(rows, 100, 5, 10, (30, 90), 256)


def test_scan_rules_out_before_the_end():
    """Bounds shrink the candidates while lines are left, and lose none of the best."""
    r = np.random.default_rng(9)
    m = (r.normal(size=(64, 3000)) * 32).round()
    a = (r.normal(size=64) * 32).round() * (np.arange(64) < 40) ** 1.0 * np.where(np.arange(64) < 8, 6, 1)
    seen, exact = [], a @ m

    def watch(inner):
        def f(least, most, total):
            seen.append(len(total))
            return inner(least, most, total)

        return f

    rows, total = negatives.vertical_scan(m, a, np.arange(3000), m.min(axis=1), m.max(axis=1), watch(negatives.best_of(5)))
    assert set(np.argsort(-exact)[:5]) <= set(rows.tolist()) and (exact[rows] == total).all() and len(rows) < 300
    windows = [(1000, 9000), (2000, 20_000)]
    rows, total = negatives.vertical_scan(m, a, np.arange(3000), m.min(axis=1), m.max(axis=1), watch(negatives.best_in(windows, 10)))
    for lo, hi in windows:
        best = sorted(x for x in exact if lo <= x <= hi)[-10:]
        assert sorted(x for x in total if lo <= x <= hi)[-10:] == best
    assert (exact[rows] == total).all() and len(rows) < 3000
