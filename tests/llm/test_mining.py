"""Brute-force versions of pivot search, phrase mining and conversation repair, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronolake.llm import conversations, language, mixing, phrases, pivots


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


# -- pivot search

VEC = "vec_id long, embedding array<float>, label int, key string, wanted string"


def brute_nearest(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, x, strict=False)))), j) for m, (j, x) in enumerate(good) if m != n]
        scores = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(i, rank, j, s) for rank, (s, j) in enumerate(scores, 1)]
    return Counter(out)


def vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.25] * 6) for i in range(150)]  # one vector, a third of all
    rows += [(450, None), (451, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (452, [float("nan")] * 6), (453, [float("inf")] * 6), (455, [0.0] * 6), (460, []), (465, [0.5]), (470, [0.5] * 9)]
    rows += [(None, [0.3] * 6), rows[50], rows[50], (50, [0.2] * 6), (-50, [-0.3] * 6)]
    return rows


@pytest.mark.parametrize("size", [(5, 7, 11), (256, 4096, 1 << 16)])
def test_nearest_is_as_all_pairs(spark, size):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors()]
    df = spark.createDataFrame([(i, v, 1, "k", "w") for i, v in rows], VEC.replace("float", "double")).repartition(5)
    got = pivots.nearest(df, F.col("vec_id") % 5 == 0, 4, pivots=size[0], block=size[1], block_queries=size[2])
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_nearest(rows, 4, 5)


def test_nearest_of_very_large_and_few_and_no_vectors(spark):
    rows = [(0, [1e14, 3.0]), (5, [-1e14, 1e14]), (10, [1e10, 1.0]), (11, [0.5, 0.5]), (15, [2.0, -7.25])]
    schema = VEC.replace("float", "double")
    for some in (rows, rows[:1], []):
        df = spark.createDataFrame([(i, v, 1, "k", "w") for i, v in some], schema)
        got = pivots.nearest(df, F.col("vec_id") % 5 == 0, 3, pivots=2, block=2)
        assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_nearest(some, 3, 5)


def test_search_leaves_blocks_out(spark):
    """Far clusters are not looked at: the bounds do their work."""
    rng = random.Random(2)
    rows = [(i, [10.0 * (i % 8 == j) + rng.gauss(0, 0.01) for j in range(8)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = pivots.classes(pivots.whole(df, wanted=F.col("vec_id") % 5 == 0))
    centres = pivots._matrix(found.orderBy("key").limit(40).select("vec").toArrow()["vec"].combine_chunks())
    index = pivots.build_index(found, centres, 20)
    asked = pivots.seeded(index).toArrow()
    run = pivots._Search(asked, centres, 5)
    blocks = [pivots._Block(b, n) for b in index.toArrow().combine_chunks().to_batches() for n in range(b.num_rows)]
    visited = []
    run.rings = lambda queries, away, block: visited.append(len(queries))
    for b in blocks:
        run.visit(b)
    assert sum(visited) < 0.4 * len(blocks) * asked.num_rows


# -- phrases


def brute_phrases(docs, support, top=2000, covered=80):
    f, n = Counter(), Counter()
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        inside = [b for (other, x), b in cand.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * b >= covered * a for b in inside):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


DOC = "doc_id long, text string, lang string, phrase string, a long"


def phrase_docs():
    rng = random.Random(9)
    words = [f"W{i}" for i in range(12)] + ["été", " x", "a" * 40]
    texts = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    docs = [("en" if i % 3 else None, t) for i, t in enumerate(texts)]
    docs += [("und", "w1 w2 w1"), ("en", None), ("en", ""), ("fr", " \t\n"), ("de", "same same same same " * 30), ("en", "w3 w4 w5 " * 3000), docs[1], docs[1]]
    return docs


@pytest.mark.parametrize("buckets", [64, 1 << 16])
def test_phrases_are_as_counted_by_hand(spark, monkeypatch, buckets):
    monkeypatch.setattr(phrases, "CHUNK", 16)
    docs = phrase_docs()
    df = spark.createDataFrame([(i, t, lang, "p", 1) for i, (lang, t) in enumerate(docs)], DOC).repartition(3)
    got = phrases.scored(*phrases.frequent(df, support=5, buckets=buckets))
    assert {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()} == brute_phrases(docs, 5)


def test_parts_overlap_where_a_text_is_cut():
    texts = [b"A b  c d. e\tf ", b"g " * 50, b"", b"x" * 30]
    whole = next(phrases.pieces(texts, 4))[0].split()
    for part in (1, 3, 7, 20):
        seen = []
        for flat, fresh in phrases.pieces(texts, 4, part):
            words = flat.split(b" ")
            assert words[:fresh] == (seen[-fresh:] if fresh else [])
            seen += words[fresh:]
        assert seen == whole and whole[:6] == [b"a", b"b", b"c", b"d", b".", b"e"]
    assert list(phrases.pieces([b"", b" \t"], 4)) == [(b".", 0)] and list(phrases.pieces([], 4)) == []


def test_equal_words_have_equal_hashes():
    starts, ends, words = phrases.hashed("ab été . ab b . été".encode())
    assert words[0] == words[3] and words[1] == words[6] and words[2] == words[5] == 0 and len(set(words.tolist())) == 4
    assert ends.tolist()[0] == 2 and starts.tolist()[1] == 3
    assert phrases.hashed("été".encode())[2][0] == words[1]


def test_phrases_of_an_empty_table(spark):
    assert phrases.scored(*phrases.frequent(spark.createDataFrame([], DOC))).collect() == []


def test_cut_texts_give_the_same_counts(spark, monkeypatch):
    docs = phrase_docs()
    monkeypatch.setattr(phrases.pieces, "__defaults__", (40,))
    monkeypatch.setattr(phrases, "FLUSH", 10)
    df = spark.createDataFrame([(i, t, lang, "p", 1) for i, (lang, t) in enumerate(docs)], DOC).repartition(2)
    got = phrases.scored(*phrases.frequent(df, support=5, buckets=256))
    assert {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()} == brute_phrases(docs, 5)


# -- conversation repair

FORM = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """The cheapest edits by trying every string of edits with up to two inserts between rows."""
    best = None
    for edits in product("DKR", repeat=len(rows)):
        for inserts in product(range(3), repeat=len(rows) + 1):
            audit, roles, texts, cost = "", "", [], 3 * sum(inserts)
            ok = True
            for k in range(len(rows) + 1):
                for _ in range(inserts[k]):
                    audit += "I"
                    role = "a" if roles[-1:] == "u" else "u"
                    roles += role
                    texts.append(({"u": "user", "a": "assistant"}[role], ""))
                if k == len(rows):
                    break
                (role, text, fault), edit = rows[k], edits[k]
                audit += edit
                if edit == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    ok = False
                    break
                cost += (3 if edit == "R" else 0) + (3 if fault == "truncated" else 0)
                if edit == "R":
                    role = "assistant" if roles[-1:] == "u" else "user"
                roles += role[:1] or "-"
                texts.append((role, text))
            if ok and FORM.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in texts))
    return best


def fault_of(rows, k):
    role, text = rows[k]
    bare = text.strip(" \t\n\x0b\x0c\r")
    return "blank" if not bare else "duplicate" if rows[k] in rows[:k] else None if bare[-1] in ".!?" else "truncated"


def brute_summary(table):
    by_conv = defaultdict(list)
    for conv, turn, role, text in table:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in by_conv.items():
        after = []
        for turn, role, text in rows:
            f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            after += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        flat = [r[1:] for r in after]
        faults = [fault_of(flat, k) for k in range(len(flat))]
        turns = [r[0] for r in after if r[0] is not None]
        cost, audit, repaired = brute_repair([(*r, f) for r, f in zip(flat, faults, strict=True)])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(flat, flat[1:], strict=False))
        counts = [faults.count(n) for n in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng = random.Random(3)
    texts = ["Hi.", "Yes!", "no end", "", None, " \t", "Hi.", "é?"]
    table = [(c, rng.choice([None, 1, 2, 3, 4, 9]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 5))]
    df = spark.createDataFrame([(*r, "x", 7) for r in table], "conv_id long, turn long, role string, text string, fault string, n long")
    got = conversations.summary(conversations.repair(conversations.damaged(df)))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute_summary(table)
    assert {r[0]: tuple(r)[1:] for r in conversations.summary(conversations.repair(conversations.damaged(df)), dealt=True).collect()} == brute_summary(table)


def test_repair_without_rows_and_without_damage(spark):
    schema = "conv_id string, turn long, role string, text string"
    assert conversations.summary(conversations.repair(spark.createDataFrame([], schema))).collect() == []
    rows = [("a", 1, "system", "S."), ("a", 2, "user", "Q?"), ("a", 3, "assistant", "A."), ("b", 1, "assistant", "A.")]
    got = {r.conv_id: r for r in conversations.summary(conversations.repair(spark.createDataFrame(rows, schema))).collect()}
    assert got["a"].audit == "KKK" and got["a"].cost == 0 and got["b"].audit == "IK" and got["b"].cost == 3
    dropped = spark.createDataFrame([("c", 1, "user", "Q?", 0)], schema + ", n int")
    assert tuple(conversations.summary(conversations.repair(dropped)).first()) == ("c", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_settled_rows_leave_memory_and_the_audit_stays_the_same():
    rng = random.Random(8)
    for n in (40, 700):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice([None, None, None, "blank", "truncated"])) for _ in range(n)]
        for most in (2, 5, 64):
            edits = list(conversations.cheapest(iter(rows), most_open=most))
            assert edits == list(conversations.cheapest(iter(rows), most_open=10**9))
    calm = [("user", None), ("assistant", None)] * 4000
    assert "".join(e for e, _, _ in conversations.cheapest(iter(calm), most_open=16)) == "K" * 8000


# -- every language, weights of nothing


def test_three_hundred_languages_are_all_learned(spark):
    """More languages than a pass holds: none is left out, and blocks of any size answer alike."""
    rng = random.Random(11)
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for n in range(300)}
    text = lambda n: " ".join(rng.choice(words[n]) for _ in range(40))
    train = spark.createDataFrame([(n, text(n), f"l{n:03}") for n in range(300) for _ in range(2)], "doc_id long, text string, lang string").repartition(4)
    probe = spark.createDataFrame([*[(n, text(n), "?") for n in range(300)], (300, None, "?"), (301, "123", "?"), (7, text(7), "?")], "doc_id long, text string, margin string").repartition(4)
    got = language.identify(probe, language.learn_blocks(train)).collect()
    assert len(got) == 303 and {r.lang_pred for r in got if r.doc_id >= 300} == {"und"}
    assert all(r.lang_pred == f"l{r.doc_id:03}" and not r.rejected for r in got if r.doc_id < 300)
    few = train.where("lang < 'l010'")
    whole = sorted(map(str, language.identify(probe, language.learn(few)).collect()))
    assert whole == sorted(map(str, language.identify(probe, language.learn_blocks(few, languages=4)).collect()))
    assert language.told(probe, language.learn_blocks(few, languages=4)).columns[:2] == ["doc_id", "text"]


def test_weights_of_nothing_and_below_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", None)], "doc_id long, text string, source string")
    assert mixing.replicate(docs, {"s": 0.0}, default=0.0).count() == 0
    with pytest.raises(ValueError, match="s"):
        mixing.replicate(docs, {"s": -1.0})
