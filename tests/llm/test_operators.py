"""Operators against plain Python on small tables with nulls, empties, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstream.llm import chat, decontam, exact, jaccard, kernels, lines, mixing, shards, suffixes, tokens, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n, vocabulary=60, length=40, copies=0.3, edits=2):
    """Random texts of which some are near or exact copies of earlier ones."""
    r, out = random.Random(seed), []
    for i in range(n):
        if out and r.random() < copies:
            w = out[r.randrange(len(out))].split(" ")
            for _ in range(r.randrange(edits + 1)):
                w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"w{r.randrange(vocabulary)}x{r.randrange(vocabulary)}" for _ in range(r.randrange(3, length))))
    return out


def word_sets(text, k):
    w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, num, den):
    sets = [(i, word_sets(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard(documents, odd_rows, small_batches, k, num):
    rows = list(enumerate(corpus(k, 160), 10)) + odd_rows + [(500, "long " + " ".join(f"a{i % 977}" for i in range(6000)))]
    got = jaccard.jaccard_components(documents(rows), k, num, 100).collect()
    want = brute_components(rows, k, num, 100)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
        else:
            assert r["component_id"] is None
    assert {r["doc_id"]: r["n_shingles"] for r in got}[500] == len(word_sets(rows[-1][1], k))
    assert len({v for v in want.values()}) < len(want) - 20


def test_jaccard_group_beyond_a_block(documents, monkeypatch):
    """A large group of near copies, split into pairs of parts."""
    r, base = random.Random(3), [f"b{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(40)] = f"c{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 25)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(documents(rows), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_jaccard_empty(documents):
    assert jaccard.jaccard_components(documents([])).count() == 0


def test_tree_keeps_all_close_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 6, (20, jaccard.GROUPS))
    v = np.vstack([np.maximum(0, base[i % 20] + r.integers(-1, 2, jaccard.GROUPS) * (r.random(jaccard.GROUPS) < 0.1)) for i in range(200)]).astype(np.int32)
    n, rows = v.sum(axis=1), np.arange(200)
    want = {(i, j) for i in range(200) for j in range(200) if np.minimum(v[i], v[j]).sum() * 185 >= 85 * (n[i] + n[j])}
    for left, right in ((rows, rows), (rows[:40], rows[40:]), (rows[:199], rows[199:])):
        found = [(i, j) for x, y, _ in jaccard.tree_pairs(n, v, left, right, 85, 100) for i, j in zip(x.tolist(), y.tolist())]
        assert len(found) == len(set(found)) and set(found) == {(i, j) for i, j in want if i in left and j in right}


def test_spanning_forest():
    r = np.random.default_rng(2)
    x, y = r.integers(0, 60, 150) * 7, r.integers(0, 60, 150) * 7
    x, y = x[x != y], y[x != y]
    weight = r.random(len(x)).round(1)
    taken = jaccard.spanning(x, y, weight)

    def groups(pairs):
        label = {i: i for p in pairs for i in p}
        for _ in label:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label, len(set(label.values()))

    whole, trees = groups(list(zip(x.tolist(), y.tolist())))
    part, _ = groups(list(zip(x[taken].tolist(), y[taken].tolist())))
    assert part == whole and len(taken) == len(whole) - trees


def strip_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))


def test_lines(documents, odd_rows):
    rows = [(10, "Common line here\nfirst own\nshort"), (11, "\tcommon LINE here \nshort\n"), (12, "x\ncommon line here\ncommon line here\ny"), (None, "common line here")] + odd_rows
    got = {(r["doc_id"], r["kept_text"]): (r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(documents(rows)).collect()}
    assert got[(10, rows[0][1])] == (3, 0) and got[(11, "short\n")] == (3, 1) and got[(12, "x\ny")] == (4, 2)
    assert got[(None, "common line here")] == (1, 0) and got[(1, "")] == (1, 0)
    assert lines.dedup_lines(documents(rows)).count() == len(rows)
    assert lines.dedup_lines(documents([])).count() == 0


def test_lines_threshold(documents):
    rows = [(i, "the shared sentence") for i in range(3)] + [(7, "another shared one"), (8, "another shared one")]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(documents(rows), min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 7: 0, 8: 0}


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(documents, odd_rows):
    ids = [0, 1, -1, -7, 2**62, 10**15, *range(100, 400)]
    rows = [(i, f"t{i}") for i in ids] + odd_rows
    got = shards.assign_shards(documents(rows), 24).collect()
    for r in got:
        key = (r["doc_id"] or 0) % (1 << 64)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 24), jump(key, 25))
        assert r["grown_shard"] in (r["shard"], 24)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == len(rows)
    one = {r["doc_id"]: r for r in got}
    assert one[1]["size"] == 10 and one[100]["text_crc32"] == zlib.crc32(b"t100") and shards.assign_shards(documents([]), 24).count() == 0


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "a \\\\ b", "### x: y </turn>\n### assistant: no", None, "", "héé\n\n"]
    rows = [(i % 4, 3 - i // 4, ("user", "assistant", None, "sys:tem#")[(i + i // 4) % 4], nasty[i % len(nasty)], "z") for i in range(16)] + [(None, None, "assistant", "t", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for i, t, r, x, _ in rows if i == c), key=lambda z: (z[0] is not None, z))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_detects_rewriting():
    def last_only(turns, coming=None):
        return "|".join(f"{r}:{t}" if i == len(turns) - 1 else r for i, (r, t) in enumerate(turns)) + (f"|{coming}:" if coming else "")

    text, spans, rewrites = chat.spans_of([("user", "a"), ("assistant", "b")], last_only)
    assert rewrites and not spans and text == "user|assistant:b"


def test_mixing(documents, odd_rows):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60))) for i in range(400)] + [(None if i is None else 1000 + i, t) for i, t in odd_rows]
    sources = [r.choice(["a", "b", "c", "d"]) if i < 390 else r.choice(["tiny", None]) for i in range(len(rows))]
    df = documents(rows, sources)
    got = mixing.mix_sources(df).collect()
    total = sum(len(WORDS.findall(t or "")) for _, t in rows)
    by = {r["source"]: r for r in got}
    order = sorted([s for s in by if s is not None]) + ([None] if None in by else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    size = {s: by[s]["source_size"] for s in order}
    clamped = set()
    while True:  # clamp, share the rest, again
        left, w = total - sum(3 * size[s] for s in clamped), sum(weight[s] for s in order if s not in clamped)
        over = [s for s in order if s not in clamped and weight[s] * left / w > 3 * size[s]]
        if not over:
            break
        clamped |= set(over)
    for s in order:
        target = 3 * size[s] if s in clamped else weight[s] * left / w
        taken = sum(x["taken"] for x in got if x["source"] == s)
        assert abs(by[s]["target"] - target) < 1e-6 and abs(taken - target) <= 60, s
    assert all(x["taken"] <= 3 * x["size"] for x in got) and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    whole = defaultdict(int)
    for x in mixing.mixed(df).collect():
        whole[(x["doc_id"], x["text"])] += 1
    want = defaultdict(int)
    texts = dict(rows)
    for x in got:
        if x["doc_id"] is not None:
            want[(x["doc_id"], texts[x["doc_id"]])] += x["repeats"]
    assert {k: v for k, v in whole.items() if k[0] is not None} == {k: v for k, v in want.items() if v}
    assert mixing.mix_sources(documents([])).count() == 0


def test_exact(documents, odd_rows):
    rows = [(i, t) for i, t in enumerate(corpus(9, 120, copies=0.6, edits=0), 20)] + odd_rows
    df = documents(rows)
    got = exact.exact_dedup(df.where("doc_id % 3 = 0"), df.where("NOT coalesce(doc_id % 3 = 0, false)")).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for r in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in groups[t])
        keep = max((i for i in groups[t] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(groups[t]), r["doc_id"] == keep)
    assert exact.exact_dedup(documents([]), documents([])).count() == 0


def test_perfect_hash():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    seeds, slots = exact.build_hash(digests)
    assert sorted(slots.tolist()) == list(range(5000)) and (exact.lookup(digests, seeds, 5000) == slots).all()


def brute_repeats(rows, match):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        lost = bytearray(len(t))
        for s in range(len(t) - match + 1):
            w = t[s : s + match]
            if w in seen:
                lost[s : s + match] = b"\1" * match
            seen.add(w)
        kept = bytes(c for c, x in zip(t, lost) if not x)
        runs = sum(1 for j, x in enumerate(lost) if x and (j == 0 or not lost[j - 1]))
        out[i] = (len(t), sum(lost), runs, kept)
    return out


def test_suffixes(documents, monkeypatch, small_batches):
    monkeypatch.setattr(suffixes, "BATCH_ROWS", 16)
    r = random.Random(2)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randrange(60, 300))) for _ in range(6)]
    rows = [(i, "".join(r.choice([r.choice(passages), "".join(r.choice("abc") for _ in range(r.randrange(90)))]) for _ in range(r.randrange(5)))) for i in range(50)]
    rows += [(60, "a" * 700), (61, "ab" * 400), (62, "b" + "a" * 300), (63, None), (64, ""), (65, rows[3][1])]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffixes.remove_repeats(documents([*rows, (None, passages[0] * 2)])).collect()}
    free = got.pop(None)
    assert free[1] == 0
    assert got == brute_repeats(rows, 100)
    assert suffixes.remove_repeats(documents([])).count() == 0


def test_decontamination(spark, documents, odd_rows):
    r = random.Random(8)
    items = [" ".join(f"q{r.randrange(300)}" for _ in range(n)) for n in (12, 40, 25, 3)]
    rows = [(i, " ".join(f"z{r.randrange(300)}" for _ in range(80))) for i in range(20)] + odd_rows
    rows += [(100, "foo " + items[0].upper() + ", bar"), (101, items[1]), (102, "x y z " + items[2].replace(" ", " \n") + " t u v"), (103, " ".join(items[1].split(" ")[:18])), (104, items[3])]
    near = items[1].split(" ")
    near[-2] = "changed"  # similarity 34/38
    rows.append((105, "a b c d " + " ".join(near) + " e f g"))
    bench = spark.createDataFrame([(i, t, "k") for i, t in enumerate(items)] + [(9, None, "k"), (None, items[0], "k")], "item_id long, text string, gram string")
    got = {(x["doc_id"], x["item_id"]): round(x["similarity"], 3) for x in decontam.find_leaks(documents(rows), bench).collect()}
    assert got == {(100, 0): 1.0, (101, 1): 1.0, (102, 2): 1.0, (105, 1): round(34 / 38, 3)}
    assert decontam.find_leaks(documents([]), bench).count() == 0 and decontam.find_leaks(documents(rows), bench.limit(0)).count() == 0


def brute_leaks(rows, items, k=5):
    """Best similarity and its first start, over all windows of all documents."""

    def grams(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = {}
    for i, text in rows:
        own = grams(text)
        for j, item in enumerate(items):
            m, want = len(grams(item)), Counter(grams(item))
            if 100 * (Counter(own) & want).total() < 80 * m:
                continue  # no window can hold enough
            for s in range(max(len(own) - m, 0) + 1):
                seen = Counter(own[s : s + m])
                both = (seen & want).total()
                if m and 100 * both >= 80 * (seen | want).total():
                    out[i, j] = max(out.get((i, j), (0, 0)), (both / (seen | want).total(), -s))
    return {x: (round(v, 6), -s) for x, (v, s) in out.items()}


def test_decontamination_at_all_starts(spark, documents):
    """Items whose sentences stand in another order, are cut, changed, repeated or longer than the document."""
    r = random.Random(12)
    items = [" ".join(f"q{r.randrange(400)}" for _ in range(r.randrange(30, 80))) for _ in range(8)] + ["ha " * 30 + "end of it", " ".join(["la lo"] * 20)]
    rows = []
    for item in items:
        w = item.split(" ")
        foreign = lambda n: [f"z{r.randrange(300)}" for _ in range(n)]
        for cut in (len(w) // 2, len(w) - 8):
            moved = w[cut:] + w[:cut]
            rows.append(foreign(80) + moved + foreign(80))
            rows.append(moved[: len(w) * 19 // 20])
            moved[len(w) // 3] = "changed"
            rows.append(foreign(5) + moved + moved + foreign(40) + w)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, "ha " * 400), (901, "la lo " * 100)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (round(x["similarity"], 6), x["start"]) for x in decontam.find_leaks(documents(rows), bench).collect()}
    want = brute_leaks(rows, items)
    assert len(want) > 20 and got == want
    exact = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(documents(rows), bench, radius=0).collect()}
    assert exact < set(want)  # fingerprints alone name the items of a window


def test_decontamination_recall_of_near_copies(spark, documents):
    """Copies of 200 items with words changed here and there: all of similarity 0.8 to 0.99 are found, among many items of each size."""
    r = random.Random(21)
    items = [[f"q{r.randrange(2000)}" for _ in range(r.choice([24, 40, 56]))] for _ in range(200)]
    rows = []
    for i, item in enumerate(items):
        w = list(item)
        for at in r.sample([*range(4), *range(len(w) - 4, len(w))], r.randrange(1, 3)):
            w[at] = f"z{r.randrange(2000)}"
        rows.append((i, " ".join([f"z{r.randrange(2000)}" for _ in range(30)] + w + [f"z{r.randrange(2000)}" for _ in range(30)])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (round(x["similarity"], 6), x["start"]) for x in decontam.find_leaks(documents(rows), bench).collect()}
    want = {}
    for i, text in rows:
        want |= {(i, i): v for (_, _), v in brute_leaks([(i, text)], [" ".join(items[i])]).items()}
    assert sum(v[0] < 0.95 for v in want.values()) > 80 and got == want


def test_simhash_finds_near_windows(spark):
    """Fingerprints of bags of similarity 0.8 lie within the radius."""
    r = random.Random(4)
    pairs = []
    for _ in range(200):
        both = [r.getrandbits(63) for _ in range(32)]
        pairs.append((both + [r.getrandbits(63) for _ in range(4)], both + [r.getrandbits(63) for _ in range(4)]))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    far = df.select(F.bit_count(decontam.simhash(F.col("a")).bitwiseXOR(decontam.simhash(F.col("b")))).alias("d")).where(F.col("d") > decontam.RADIUS).count()
    assert far == 0


def test_tokens(documents, odd_rows):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "été", "naïve", "x1", "…", "<s>", "日本語", "a  b", "\n"]) for _ in range(20000))
    rows = [*odd_rows, (70, long), (71, "x" * 30000), (72, " lead and trail ")]
    got = tokens.count_tokens(documents(rows), path, 100).collect()
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_tokens"]) for x in got) == want
    assert {x["doc_id"] for x in got if x["over_limit"]} == {70, 71} and tokens.count_tokens(documents([]), path, 1).count() == 0


def test_tokens_json(documents):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["hello world", "", None, "<|endoftext|> é"]
    got = {x["doc_id"]: x["n_tokens"] for x in tokens.count_tokens(documents(list(enumerate(texts))), path, 10).collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def toxic_corpus(n):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(10, 60))]
        bad = r.random() < 0.3
        if bad:
            w[r.randrange(len(w))] = r.choice(["vile", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad), "k"))
    return rows, labels


def test_toxicity(spark, documents, odd_rows):
    rows, labels = toxic_corpus(400)
    lab = spark.createDataFrame([*labels, (None, 1, 1, "k"), (399, 1, None, "k")], "doc_id long, quality int, toxic int, score string")
    shifted = [(None if i is None else 1000 + i, t) for i, t in odd_rows]
    got = toxicity.score_toxicity(documents(rows + shifted), lab).collect()
    truth = {i: y for i, _, y, _ in labels}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got if x["doc_id"] is not None)
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held) and all(0 <= x["score"] <= 1 for x in got)
    assert all(zlib.crc32(str(e).encode()) % 5 for x in got for e in x["evidence"])
    assert toxicity.score_toxicity(documents([]), lab).count() == 0
    assert {x["score"] for x in toxicity.score_toxicity(documents(odd_rows), lab.limit(0)).collect()} == {0.0}


def brute_toxicity(rows, labels):
    """Score and evidence of every text, from all cosines with all examples."""
    terms = {i: Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for i, t in rows}
    known = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    examples = sorted(i for i in known if i in terms)
    rate = (sum(known[i] for i in examples) + 0.5) / (len(examples) + 1)
    vocabulary = {w for i in examples for w in terms[i]}
    factor = {}
    for w in vocabulary:
        own = [known[i] for i in examples if w in terms[i]]
        n, p = len(own), sum(own) / len(own)
        low = (p + 4.5 / n - 3 * np.sqrt(p * (1 - p) / n + 2.25 / (n * n))) / (1 + 9 / n)
        factor[w] = np.log((1 + len(rows)) / sum(w in x for x in terms.values())) * (0.03 + 0.97 * min(1, max(0, (low - rate) / (1 - rate))))

    def vector(i):
        v = {w: (1 + np.log(n)) * factor[w] for w, n in terms[i].items() if w in factor}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    space, out = {i: vector(i) for i in examples}, {}
    bare = [known[i] for i in examples if not terms[i]]
    for i, _ in rows:
        v = vector(i)
        if not v:
            out[i] = ((sum(bare) + 0.25 * rate) / (len(bare) + 0.25), [])
            continue
        cos = sorted(((-sum(x * space[e].get(w, 0) for w, x in v.items()), e) for e in examples), key=lambda z: (round(z[0], 10), z[1]))
        near = [(-c, e) for c, e in cos if c < 0][:15]
        out[i] = ((sum(c * known[e] for c, e in near) + 0.25 * rate) / (sum(c for c, _ in near) + 0.25), [e for _, e in near[:3]])
    return out


def test_toxicity_is_the_vote_of_all_cosines(spark, documents, small_batches):
    """Scores and evidence against all pairs, with long texts, other scripts, ties among neighbours and repeated texts."""
    rows, labels = toxic_corpus(150)
    rows += [(500, rows[7][1]), (501, rows[7][1].upper()), (502, None), (503, ""), (504, "vile"), (505, "naïve 日本語 déjà-vu"), (506, "ß NAÏVE vile"), (507, " ".join(f"w{i % 700}" for i in range(9000))), (508, "unknown words only")]
    labels = [(i, y) for i, _, y, _ in labels] + [(500, labels[7][2]), (501, labels[7][2]), (502, 0), (503, 1), (505, 0), (507, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    want = brute_toxicity(rows, labels)
    got = {x["doc_id"]: (x["score"], x["evidence"]) for x in toxicity.score_toxicity(documents(rows), lab).collect()}
    assert set(got) == set(want)
    for i, (score, evidence) in want.items():
        assert abs(got[i][0] - score) < 1e-9 and got[i][1] == evidence, i
    assert all(evidence for i, (_, evidence) in got.items() if i not in (502, 503, 508))


def test_nearest_is_exact():
    r = np.random.default_rng(3)
    dense = np.zeros((700, 40))
    for i in range(700):
        ids = np.sort(r.choice(40, r.integers(1, 20), replace=False))
        dense[i, ids] = r.integers(1, 4, len(ids))  # few values, so that cosines tie
        dense[i] /= np.sqrt((dense[i] ** 2).sum())
    example, term = np.nonzero(dense)
    for terms, shift in ((40, 0), (40 * 700, 1)):  # with terms of many examples, and with terms of one example each
        index = toxicity.BlockMaxIndex(terms, term * (1 + 699 * shift) + shift * example, example, dense[example, term], 700)
        assert (index.row >= 0).any() != bool(shift) and index.n > 10 * toxicity.FIRST
        for i in range(120):
            ids = np.flatnonzero(dense[i])
            cos = dense @ dense[i] if not shift else (np.arange(700) == i).astype(float)
            order = np.lexsort((np.arange(700), -cos.round(12)))[:15]
            near, s = index.nearest(ids * (1 + 699 * shift) + shift * i, dense[i, ids], 15)
            assert np.allclose(cos[order[cos[order] > 0]], s) and np.allclose(cos[near], s) and len(set(near.tolist())) == len(near)
        assert all(len(x) == 0 for x in index.nearest(np.zeros(0, dtype=np.int64), np.zeros(0), 15))


def test_rolling_hashes_equal_strings():
    roll = kernels.Rolling(1)
    buf = np.frombuffer(b"abcdefabcdefxabcdef", dtype=np.uint8)
    sums = roll.sums(buf)
    h = roll.ranges(sums, np.array([0, 6, 13, 1]), np.array([6, 12, 19, 7]))
    assert h[0] == h[1] == h[2] != h[3]


def test_jaccard_tells_words_apart_that_cancel_under_powers(documents):
    """The two Thue-Morse words over a and b agree under any polynomial modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word[:1024]), (2, word[1024:]), (3, word), (4, word.translate(str.maketrans("ab", "ba"))), (5, word)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(rows), 4, 85, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
