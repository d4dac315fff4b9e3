"""Probes of a demand against a plain fold of the same rules."""

import random
import re
import unicodedata

import pytest

from shelfstream import plans
from shelfstream.functions.text import CONTEXT_STOP
from shelfstream.operators import demand as D

SCHEMA = (
    "id long, mode string, query string, semantic_query string, intent string, types array<string>, facets array<string>, negatives array<string>, reference_terms array<string>, "
    "expansions array<string>, axes array<array<string>>, needs array<string>, blocked array<string>, catalog_types array<string>, catalog_values array<string>"
)


def fold(v):
    v = "".join(c for c in unicodedata.normalize("NFD", v.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"[^\w]+|_", " ", v).strip()


def squash(v):
    return re.sub(r"\s+", " ", v or "").strip()


def texts(values):
    return [v for v in map(squash, values or []) if v]


def once(values, key=fold):
    seen, out = set(), []
    for v in values:
        if key(v) not in seen:
            seen.add(key(v))
            out.append(v)
    return out


def listed(v):
    return (v or [""])[0] if len(v) <= 1 else " and ".join(v) if len(v) == 2 else ", ".join(v[:-1]) + ", and " + v[-1]


def contexts(p):
    values = p["needs"] if p["axes"] is None else [a[0] for a in p["axes"] if a] + [x for a in p["axes"] for x in (a or [])[1:]]
    barred = {fold(b) for b in p["blocked"] or []}
    good = [v for v in texts(values) if not re.search(r"\d", v) and fold(v) and fold(v) not in barred and any(w not in D.GENERIC_CONTEXT for w in fold(v).split())]
    return once(good)[:8]


def class_words(v):
    return [w for w in v.split() if len(w) >= 2 and w not in CONTEXT_STOP and w not in D.GENERIC_CONTEXT]


def of_type(a, b):
    a, b = class_words(a), class_words(b)
    return bool(a and b) and a[-1] == b[-1] and (len(a) == 1 or len(b) == 1 or len(set(a) & set(b)) >= 2)


def same_name(a, b):
    part = lambda x, y: len(y.split()) >= 2 and f" {y} " in f" {x} "
    return bool(a and b) and (a == b or part(a, b) or part(b, a))


def identity_words(p):
    for v in texts(p["types"]):
        w = [x for x in fold(v).split() if (len(x) >= 2 and x not in CONTEXT_STOP or x in D.IDENTITY_LETTERS) and x not in D.AUDIENCE_WORDS]
        if w:
            return " ".join(w)
    return None


def probes(p):
    query, semantic, intent = ((x if squash(x) else None) for x in (p["query"], p["semantic_query"], p["intent"]))
    ctx, out = contexts(p), []
    own = identity_words(p)
    grounded = lambda ok: sorted(enumerate(p["expansions"] or []), key=lambda e: (not ok(fold(e[1])), e[0]))
    if p["mode"] == "DISCOVERY":
        primary = intent or semantic or query or ""
        key, seen = fold(primary), set()
        for _, e in grounded(lambda k: any(of_type(k, fold(t)) for t in p["catalog_types"] or [])):
            k = fold(e)
            if not k or k == key or key and (k in key or key in k) or k in seen:
                continue
            seen.add(k)
            needs = []
            for c in ctx:
                if fold(c) not in k and not any(fold(c) in fold(n) for n in needs):
                    needs.append(c)
            out.append(("EXPANSION", ((squash(e) + " suitable for " + listed(needs)) if needs else squash(e))[:260].strip()))
        out = out[:4]
    elif p["mode"] == "COMPLEMENT":
        primary = semantic or intent or query or ""
        key, refs = fold(primary), {w for v in p["reference_terms"] or [] for w in fold(v).split()}
        seen = set()
        if texts(p["reference_terms"]):
            target = (texts(p["types"]) or [semantic or query])[0]
            pair = f"{target} ; pair with {texts(p['reference_terms'])[0]}"[:220].strip()
            if target is not None and fold(pair) != key:
                out, seen = [("PAIR", pair)], {fold(pair)}
        for _, e in grounded(lambda k: any(same_name(k, fold(v)) for v in p["catalog_values"] or [])):
            k = fold(e)
            if k and k != key and not all(w in refs for w in k.split()) and k not in seen:
                seen.add(k)
                out.append(("EXPANSION", squash(e)[:220]))
        out = out[:4]
    else:
        primary = query or semantic or intent or own or ""
        if p["mode"] == "DIRECT":
            key, barred, raw = fold(primary), {fold(n) for n in p["negatives"] or []}, texts(p["facets"])
            facets = once([f for f in raw if not re.fullmatch(r"\s*\d+([.,]\d+)?\s*", f) and fold(f) not in barred])
            facets = [f for f in facets if fold(f) not in key][:4]
            covered = set(key.split()) | {w for f in raw for w in fold(f).split()}
            barred_words = {w for n in barred for w in n.split()}
            left = once([w for w in fold(semantic or query or "").split() if len(w) > 1 and w not in covered and w not in barred_words and w not in D.RESIDUAL_STOP])
            rows = [("IDENTITY", own or ""), ("FACETS", f"{primary} with {listed(facets)}"[:260] if facets else ""), ("RESIDUAL", f"{primary} for {' '.join(left)}"[:260] if left else "")]
            more = [e for e in once([e for e in texts(p["expansions"]) if fold(e) not in barred]) if fold(e) != key][:2]
            rows += [("EXPANSION", f"{e} suitable for {listed(ctx)}"[:300] if ctx else e) for e in more]
            rows = [(k, t.strip()) for k, t in rows if t.strip() and fold(t) != key]
            out = once(rows, lambda r: fold(r[1]))[:3]
    return [(i, *r) for i, r in enumerate([("PRIMARY", primary), *out])]


WORDS = "office laptop bag bags leather black running shoes shoe phone case the with for men Élan gear 42 25.4mm all-in-one printer x red 18".split()


def profiles(n, seed=1):
    r = random.Random(seed)
    text = lambda most=4: r.choice([" ", "  "]).join(r.choice(WORDS) for _ in range(r.randrange(0, most)))
    many = lambda most=5, size=3: r.choice([None, [r.choice([text(size), text(size), None]) for _ in range(r.randrange(most))]])
    out = []
    for i in range(n):
        out.append((i, r.choice(["DIRECT", "DISCOVERY", "COMPLEMENT", "COMPLEMENT", "DIRECT", "OTHER"]), r.choice([text(7), text(7), None]), r.choice([text(6), None]), r.choice([text(4), None]), many(3), many(6), many(3), many(3), many(9), r.choice([None, [[text(3) for _ in range(r.randrange(4))] for _ in range(6)]]), many(4), many(3), many(4), many(4)))
    out.append((n, "DIRECT", "bag " * 120, "bag", None, ["Bag"], ["long " * 80], None, None, ["wide " * 90], None, ["soft"], None, None, None))
    out.append((n + 1, "DISCOVERY", "bag", None, None, None, None, None, None, ["wide " * 90, "tote", "satchel", "pouch", "sack"], [["a long day " * 30]], None, None, None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_probes(spark, seed):
    rows = profiles(500, seed)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    got = {}
    for r in D.demand_probes(spark.createDataFrame(rows, SCHEMA), ["id"]).collect():
        got.setdefault(r["id"], []).append((r["probe"], r["kind"], r["text"]))
    kinds = set()
    for row in rows:
        p = {k: [v for v in x if v is not None] if isinstance(x, list) and k != "axes" else x for k, x in zip(names, row)}
        want = probes(p)
        assert sorted(got[row[0]]) == want, p
        kinds |= {(p["mode"], k) for _, k, _ in want} | {(p["mode"], len(want))}
    assert kinds >= {("DIRECT", k) for k in ("IDENTITY", "FACETS", "RESIDUAL", "EXPANSION")} | {("DISCOVERY", "EXPANSION"), ("COMPLEMENT", "PAIR"), ("COMPLEMENT", "EXPANSION"), ("DIRECT", 4), ("DISCOVERY", 5), ("COMPLEMENT", 5), ("OTHER", 1)}
    assert D.demand_probes(spark.createDataFrame([], SCHEMA), ["id"]).count() == 0


def test_probes_of_the_tables(spark, sf_dir):
    got = plans.QUERIES["doc15_demand_probes"](spark, sf_dir).collect()
    kinds = {r["kind"] for r in got}
    assert kinds == {"PRIMARY", "IDENTITY", "FACETS", "RESIDUAL", "EXPANSION", "PAIR"} and all(len(r["text"]) <= 300 for r in got)
