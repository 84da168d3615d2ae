"""Edge cases and brute-force versions of the training-data operators, on small tables."""

import bisect
import math
import random
import zlib
from collections import Counter

import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronolake.llm import chat, decontaminate, language, lm, mixing, neardup, quality, sharding, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, spans string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty texts, one word, copies, near copies, a repeated row, a long text, clashing column names."""
    rng = random.Random(1)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(120)) for _ in range(6)]
    texts = [None, "", "one", *base, base[0], base[0].replace("alpha", "ALPHA"), base[1] + " more", "x " * 300_000, "!!! 123"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", 1, "a", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, base[2], "en", "s1", 1, "a", "b")], DOC)


def brute_components(pairs, size):
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().translate(decontaminate.ALNUM and neardup.LOWER).split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_near_duplicates(docs):
    got = neardup.linked_components(docs, size=2).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_components(dict(rows).items(), 2)
    assert len(got) == docs.count() and [r.kept for r in got if r.doc_id is None] == [True]
    kept = [r.doc_id for r in neardup.unique(docs, size=2).collect()]
    assert len(kept) == len(set(kept)) and neardup.linked_components(docs.limit(0)).count() == 0


def test_near_duplicates_of_large_buckets(spark, docs, monkeypatch):
    """Texts of large buckets meet by their rarest shingles: all links, and few pairs of a family that is not similar enough."""
    monkeypatch.setattr(neardup, "BUCKET", 2)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    rng = random.Random(3)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(90):
        text = list(template)
        for k in rng.sample(range(60), rng.choice((1, 3, 4, 5, 6))):
            text[k] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(text[: rng.choice((60, 60, 52))])))
    got = neardup.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 2) and len({r.component_id for r in got}) > 10

    family = [(i, " ".join(template[:40] + [f"u{i}x{k}" for k in range(20)])) for i in range(200)]
    frame = neardup.sketch(spark.createDataFrame(family, "doc_id long, text string"), 2)
    members = frame.select("doc_id", F.col("doc_id").alias("comp"), F.struct(F.col("n_shingles").alias("n"), "low", "odd").alias("sign"))
    texts = spark.createDataFrame(family, "doc_id long, text string")
    assert neardup.rare_pairs(members, texts, 0.8, 2).count() == 0
    near = spark.createDataFrame([(i, t if i else family[1][1] + " more") for i, t in family], "doc_id long, text string")
    members = neardup.sketch(near, 2).select("doc_id", F.col("doc_id").alias("comp"), F.struct(F.col("n_shingles").alias("n"), "low", "odd").alias("sign"))
    assert [tuple(r) for r in neardup.rare_pairs(members, near, 0.8, 2).collect()] == [(0, 1)]


def test_near_duplicates_of_repeated_ids(spark):
    """Ids with several texts: whichever row comes first, links are those of the texts."""
    rng = random.Random(9)
    a, b, c = (" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (1, a), (None, a), (4, a + " end"), (4, None)]
    for order in (rows, rows[::-1], [rows[k] for k in (3, 1, 6, 0, 7, 2, 5, 4)]):
        got = neardup.linked_components(spark.createDataFrame(order, "doc_id long, text string"), size=2).select("doc_id", "component_id", "n_shingles").collect()
        assert sorted(map(str, ((r.doc_id, r.component_id, r.n_shingles) for r in got))) == sorted(map(str, [(1, 1, 59), (1, 1, 59), (2, 1, 60), (3, 3, 59), (1, 1, 59), (None, None, 59), (4, 1, 60), (4, 4, 0)]))


def test_decontamination(spark, docs):
    rows = docs.collect()
    passage = " ".join(rows[4].text.split()[20:32])
    items = spark.createDataFrame([(1, passage.upper()), (2, "one"), (3, None), (4, "nothing of this is in any text at all here now"), (None, "one"), (1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(decontaminate.phrase_matches(docs, items)).collect()}
    assert (got[4].n_hit, got[4].n_items, got[2].n_hit, got[2].n_items, got[0].n_words) == (12, 1, 1, 1, 0)
    assert not got[7].contaminated and not got[13].contaminated
    blocks = {r.doc_id: r for r in decontaminate.contamination(decontaminate.phrase_matches(docs, items, block_windows=2, shard_bytes=2000)).collect()}
    assert blocks == got
    assert decontaminate.clean(docs, items).where("doc_id in (2, 4)").count() == 0
    assert decontaminate.phrase_matches(docs.limit(0), items).count() == 0 and decontaminate.phrase_matches(docs, items.limit(0)).where("size(spans) > 0").count() == 0


def test_proximity_is_as_brute_force(spark, docs):
    """Windows whose words all stand near their rarest one, in any order, by looking at every place."""
    rows = [(r.doc_id, [w for part in decontaminate._terms((r.text or "").encode()) for w in part]) for r in docs.where("doc_id is null or doc_id <> 12").collect()]
    w = rows[4][1]
    items = [(1, w[3:7][::-1]), (2, [w[0], w[40]]), (3, w[10:12] + [b"z" * 70]), (4, [w[90], w[90]]), (5, [b"no"])]
    long = (77, [*w[60:62], b"z" * 70, w[10], w[11]])
    rows, slop, length = [*rows, long], 4, 3
    count = Counter(x for _, ws in rows for x in ws)
    want = {}
    for n, ws in rows:
        for item, words in items:
            for win in decontaminate.windows(words, length):
                rare = min(((count[x], x, k) for k, x in enumerate(win)))[1]
                if any(x == rare and all(y in ws[max(0, k - slop) : k + slop + 1] for y in win) for k, x in enumerate(ws)):
                    want.setdefault((n, len(ws)), set()).add(item)
    frame = spark.createDataFrame([(n, " ".join(x.decode() for x in ws)) for n, ws in rows], "doc_id long, text string")
    asked = spark.createDataFrame([(n, " ".join(x.decode() for x in ws)) for n, ws in items], "item_id long, text string")
    for size in (1, 1 << 17):
        found = decontaminate.phrase_matches(frame, asked, length, slop=slop, block_windows=size, shard_bytes=1500).where("size(near_items) > 0").collect()
        assert {(r.doc_id, r.n_words): set(r.near_items) for r in found} == want and {1, 3} <= set().union(*want.values())
    assert sorted(r.doc_id for r in decontaminate.near_matches(frame, asked, slop, length).where("array_contains(items, 3)").collect()) == [77]


def plain_mcd(x, cover):
    """FAST-MCD of all rows at once, no cells and no classes of distances; then the reweighting step."""
    np, p = quality.np, x.shape[1]
    centre, cov, _ = quality.cell_mcd(x, 1, cover)

    def inside(centre, cov, cut):
        z = x - centre
        return x[(z @ np.linalg.inv(cov) * z).sum(1) <= cut]

    near = inside(centre, cov * quality.consistency(cover), quality.chi2_quantile(0.025, p))
    return near.mean(0), np.cov(near.T, bias=True) * quality.consistency(0.975) + np.eye(p) * quality.RIDGE


def brute_verdicts(rows):
    """doc_id -> squared distance by plain estimates of each language and source, each language, and all, weighed."""
    np, x, groups = quality.np, {}, {}
    for i, t, lang, source, *_ in rows:
        c = quality.text_counts(t)
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0]:
            x[i] = quality.features(*c)
            for g in ((lang, source), (lang,), ()):
                groups.setdefault(g, {})[source, t] = x[i]
    found = {g: (len(v), *plain_mcd(np.array(list(v.values())), quality.COVER)) for g, v in groups.items()}
    out = {}
    for i, _, lang, source, *_ in rows:
        if i in x:
            _, m, c = found[()]
            for g in ((lang,), (lang, source)):
                n, m1, c1 = found[g]
                w = n / (n + quality.SHRINK)
                m, c = w * m1 + (1 - w) * m, w * c1 + (1 - w) * c
            z = np.array(x[i]) - m
            out[i] = float(z @ np.linalg.inv(c) @ z)
    return out


def test_quality_counts_and_verdicts(spark, docs):
    assert quality.text_counts("a b c\na b c\n\nd #|") == (8, 9, 2, 1, 6, 3, 0, 2, 5)
    assert quality.text_counts(None)[:5] == (0, 0, 0, 0, 0)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 4, 5, 6, 9))))
    line = lambda: " ".join([word().capitalize(), *(word() for _ in range(rng.randrange(6, 14)))]) + rng.choice((".", ",", "!,"))
    text = lambda: "\n".join(line() for _ in range(rng.randrange(8, 20)))
    rows = [(i, text(), "en" if i % 3 else None, f"s{i % 4 // 3}", 1, "", "") for i in range(700)]
    copy = text() + " #######" * 60
    rows = [(i, copy, *r) if i % 3 == 1 else (i, t, *r) for i, t, *r in rows]  # a third are copies of one bad text
    rows[0], lined = (0, rows[0][1] + " ###" * 60, *rows[0][2:]), "\n".join(line() for _ in range(8))
    rows[3] = (3, lined + ("\n" + lined.split("\n")[0]) * 5 + "\n" + "\n".join(line() for _ in range(3)), *rows[3][2:])
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    want = brute_verdicts(rows)
    cut = quality.chi2_quantile(quality.TAIL, quality.P)
    assert {i for i, r in got.items() if r.distance2 is not None} == set(want)
    clear = [i for i, d in want.items() if not 0.7 < d / cut < 1.4]
    assert len(clear) > 600 and all(got[i].kept == (want[i] <= cut) for i in clear)
    assert not any(got[i].kept for i in (0, 1, 4, 7)) and sum(r.kept for i, r in got.items() if i % 3 != 1) >= 0.95 * 466
    cells = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOC), cell_rows=100).collect()}
    assert sum(cells[i].kept == got[i].kept for i in got) >= 690
    assert len(quality.judge(docs).collect()) == docs.count() and quality.judge(docs.limit(0)).count() == 0
    assert abs(quality.chi2_quantile(0.05, 5) - 11.0705) < 1e-3


def test_sharding_is_minimax(spark, docs):
    rng = random.Random(3)
    groups = sorted((rng.randrange(1 << 60), rng.choice([9, 50, 4000])) for _ in range(200))

    def need(cap):
        count, held = 1, 0
        for _, size in groups:
            count, held = (count + 1, size) if held + size > cap else (count, held + size)
        return count if max(s for _, s in groups) <= cap else 10**9

    best = bisect.bisect_left(range(sum(s for _, s in groups)), True, key=lambda c: need(c) <= 7)
    assert sharding.smallest_cuts(spark.createDataFrame(groups, "key long, bytes long"), 7)[0] == best
    got = sharding.shard(docs, 4, rows_per_bucket=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(got) == docs.count()
    assert len({r.shard for r in got if r.doc_id in (3, 9)}) == 1 and sharding.shard(docs.limit(0)).count() == 0


def test_slots_of_copies_are_listed_in_blocks(spark):
    same = spark.createDataFrame([(1, "copy")] * 7 + [(2, "other"), (None, None)], "doc_id long, text string")
    got = sharding.shard(same, 1, block=3).collect()
    assert sorted(r.slot for r in got) == list(range(9)) and len({r.slot for r in got if r.doc_id == 1}) == 7


def test_mixing(docs):
    got = mixing.replicate(docs, {"s0": 3.0}, epochs=4.0)
    assert got.columns == [*docs.columns, *mixing.ADDED]
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.replicate(docs.repartition(7), {"s0": 3.0}, epochs=4.0).collect()))
    assert mixing.replicate(docs.limit(0)).count() == 0


def test_mixing_gives_every_rate_its_copies(spark):
    """One row of a source that is tiny beside the others, and a source whose rows are drawn in parts."""
    rows = [(i, "x" * 49, "rare") for i in range(40)] + [(99, "x" * 249, None)] + [(100 + i, "y" * 19_999, "big") for i in range(600)]
    got = mixing.replicate(spark.createDataFrame(rows, "doc_id long, text string, source string"), {})
    n = {r.doc_id: (r.n, r.most, r.copies, r.kinds) for r in got.where("doc_id < 100").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_copy").alias("most"), F.max("mix_copies").alias("copies"), F.countDistinct("mix_copy").alias("kinds")).collect()}
    total = sum(len(t) + 1 for _, t, _ in rows)
    rate, one = total / 3 / 2000, total / 3 / 250
    assert rate > 2000 and one > 16_000 and all(len(set(x)) == 1 for x in n.values())
    assert abs(n[99][0] - one) < 6 * one**0.5
    drawn = [n[i][0] for i in range(40)]
    mean = sum(drawn) / 40
    assert abs(mean - rate) < 6 * (rate / 40) ** 0.5 and 0.3 < sum((x - mean) ** 2 for x in drawn) / 39 / rate < 2.2


def test_mixing_lists_copies_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 50, f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    whole = sorted(map(str, mixing.replicate(docs, epochs=20.0).collect()))
    monkeypatch.setattr(mixing, "BLOCK", 3)
    assert sorted(map(str, mixing.replicate(docs, epochs=20.0).collect())) == whole and len(whole) > 200


def test_language(spark, docs):
    rng = random.Random(4)
    said = {"en": "the cat and this house with rain over hills".split(), "de": "der hund und das haus mit regen über berge".split()}
    rows = [(i, " ".join(rng.choice(said[k]) for _ in range(60)), k, "s", 1, "", "") for i in range(60) for k in said]
    learned = language.learn(spark.createDataFrame(rows, DOC))
    probe = spark.createDataFrame([(1, "the house and the rain with this cat over hills the rain"), (2, "der regen und das haus mit hund über berge der hund"), (3, None), (4, "12 %"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(probe, learned).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[3].rejected
    assert language.identify(docs, learned).count() == docs.count() and language.learn(docs.limit(0)) == {}


def test_language_is_as_plain_zstandard(spark):
    """The whole query against dictionaries and sizes made by hand."""
    rng = random.Random(11)
    said = {"en": "the cat and this house with rain over hills".split(), "de": "der hund und das haus mit regen über berge".split(), "hi": "\u0915\u093f\u0924\u093e\u092c \u0918\u0930 \u0928\u0926\u0940 \u092e\u0947\u0902 \u0939\u0948".split()}
    rows = [(i, " ".join(rng.choice(said[k]) for _ in range(rng.randrange(1, 90))), k) for i, k in enumerate([*said] * 25)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "7 %", "en"), (203, rows[0][1], None), (204, "the hund \u0918\u0930", "en"), (5, rows[1][1], "de")]
    crc = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    texts = {}
    for i, t, k in rows:
        if not crc(i) and k and t:
            texts.setdefault(k, {})[xxhash.xxh64(t.encode(), seed=42).intdigest()] = t
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    coders = []
    for k in sorted(texts):
        data = "\n".join(regex.sub(r"[^\p{L}\p{M}]+", " ", texts[k][h].lower()) for h in sorted(texts[k], key=signed)).encode()
        coders.append((k, zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)))
    want = []
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            want.append((i, crc(i), "und", 0.0))
            continue
        sizes = sorted((len(c.compress(regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).encode())), k) for k, c in coders)
        gap = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
        want.append((i, crc(i), sizes[0][1], round(1 - 0.5 * language.MARGIN / (language.MARGIN + gap), 9)))
    docs = spark.createDataFrame([(i, t, k, "s", 1, "", "") for i, t, k in rows], DOC)
    found = language.identify(docs, language.learn(docs.where(~language.held_out(F.col("doc_id"))))).collect()
    held = {r.doc_id: r.h for r in docs.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()}
    assert sorted(map(str, ((r.doc_id, held[r.doc_id], r.lang_pred, round(r.score, 9)) for r in found))) == sorted(map(str, want))
    assert language.join([b"ab", b"cd", b"e"], 4) == b"ab\ne" and language.join(["ü".encode() * 9], 8).decode() == "üü"


def test_language_learns_from_different_texts(spark):
    """A language of 20 texts with 500 copies each, and one text copied 5000 times beside 99 others."""
    few = spark.range(10_000).select(F.concat(F.lit("few "), F.translate((F.col("id") % 20).cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("few").alias("lang"))
    hot = spark.range(5_100).select(F.concat(F.lit("hot "), F.translate(F.greatest(F.col("id") - 5_000, F.lit(0)).cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("hot").alias("lang"))
    got = {k: v.decode().split("\n") for k, v in language.learn(few.unionByName(hot)).items()}
    assert len(got["few"]) == len(set(got["few"])) == 20
    assert len(got["hot"]) == len(set(got["hot"])) == 80


def brute_losses(rows, targets, strength):
    """Plain counts of every word and pair; of each row, its own taken out."""
    seqs = [["", *(w.decode() for part in lm.words((t or "").encode(), lm.ALNUM) for w in part), ""] for _, t in rows]
    sides = [i in targets for i, _ in rows]
    pairs = [list(zip(s, s[1:], strict=False)) if len(s) > 2 else [] for s in seqs]
    vocab, out = len({w for p in pairs for _, w in p}), []
    for k, own in enumerate(pairs):
        loss, models = [], []
        for side in (True, False):
            rest = [x for n, p in enumerate(pairs) if sides[n] is side and n != k for x in p]
            one, two = Counter(w for _, w in rest), Counter(rest)
            models.append((len(rest), one, two))
        mass = min(m[0] for m in models)
        for words_, one, two in models:
            f = mass / words_ if words_ else 0
            loss.append(sum(-math.log((f * two[h, w] + strength * (f * one[w] + 1) / (mass + vocab)) / (f * one[h] + strength)) for h, w in own) / max(1, len(own)))
        out.append((rows[k][0], max(0, len(own) - 1), *loss))
    return out


def test_lm_is_as_plain_counts(docs):
    short = docs.where("doc_id is null or doc_id <> 12")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    want = sorted(brute_losses(rows, {3, 5, 4}, 2.0), key=str)
    targets = short.where("doc_id in (3, 4, 5)").select("doc_id").unionByName(short.select(F.lit(None).cast("long").alias("doc_id")))
    for size, keys in ((1 << 20, 1 << 20), (1500, 100)):
        got = sorted([(r.doc_id, r.n_words, r.loss_target, r.loss_background) for r in lm.cross_entropy_difference(short, targets, 2.0, block_bytes=size, bucket_keys=keys).collect()], key=str)
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(x - y) < 1e-9 for g, w in zip(got, want, strict=True) for x, y in zip(g[2:], w[2:], strict=True))
    assert len(lm.cross_entropy_difference(docs, targets.limit(0)).collect()) == docs.count()
    assert lm.cross_entropy_difference(docs.limit(0), targets).count() == 0


def test_lm_sizes_are_matched(spark):
    """A background that is the target several times over scores nothing; without a background nothing scores."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(99, "alpha of its own " + texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(frame, frame.where("doc_id < 8").select("doc_id")).collect()}
    assert abs(got[99].score) < 1e-12 and got[99].loss_target > 0 and got[0].score > 0 > got[8].score
    alone = lm.cross_entropy_difference(frame, frame.select("doc_id")).collect()
    assert {r.score for r in alone} == {0.0} and len(alone) == len(rows)


def brute_scores(rows, share, texts):
    """Plain dictionaries: TF-IDF of all words, all cosines, votes, and the calibration of the operator."""
    counts = [Counter(w for part in toxicity.words(t.encode(), toxicity.ALNUM) for w in part) for _, t, _ in rows]

    def model(used):
        n = [sum(1 for k in used if rows[k][2] == y) for y in (0, 1)]
        weight = {}
        for w in {w for k in used for w in counts[k]}:
            have = [sum(1 for k in used if rows[k][2] == y and w in counts[k]) for y in (0, 1)]
            g = 0.0
            for a, row in ((have, sum(have)), ([n[y] - have[y] for y in (0, 1)], len(used) - sum(have))):
                g += sum(2 * a[y] * math.log(a[y] / (row * n[y] / len(used))) for y in (0, 1) if a[y])
            weight[w] = (math.log((1 + len(used)) / (1 + sum(have))) + 1) * (1 + toxicity.BOOST * max(0, g - 1))
        return weight, math.log(1 + len(used)) + 1

    def unit(c, weight, other):
        v = {w: (1 + math.log(n)) * weight.get(w, other) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / length for w, x in v.items() if w in weight}

    def vote(c, used, weight, other):
        q = unit(c, weight, other)
        found = []
        for k in used:
            v = unit(counts[k], weight, other)
            found.append((-round(sum(x * v[w] for w, x in q.items() if w in v), 12), k))
        near = [(s, k) for s, k in sorted(found)[: toxicity.NEAREST] if s < 0]
        return sum(-s * (2 * rows[k][2] - 1) for s, k in near) / toxicity.NEAREST

    votes = []
    for k in range(len(rows)):
        used = [j for j in range(len(rows)) if j % toxicity.FOLDS != k % toxicity.FOLDS]
        votes.append(vote(counts[k], used, *model(used)))
    y = toxicity.np.array([r[2] for r in rows], float)
    at, value = toxicity.isotonic(toxicity.np.round(votes, 9), y, toxicity.np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    whole = model(range(len(rows)))
    return [float(toxicity.np.interp(vote(Counter(w for part in toxicity.words((t or "").encode(), toxicity.ALNUM) for w in part), range(len(rows)), *whole), at, value)) for t in texts]


def test_toxicity_is_as_plain_cosines(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(3)) for _ in range(30)) + (" vile nasty" if i % 4 == 0 else "") + (" vile" if i == 7 else ""), int(i % 4 == 0)) for i in range(60)]
    texts = [None, "", "alpha0 vile thing", rows[0][1], "nasty", "no word of these", rows[3][1] + " other words"]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 1), (99, 1), (5, None)], "doc_id long, toxic int")  # 3 has two labels
    sample, share = toxicity.examples(frame, labels)
    assert sorted(r[0] for r in sample) == [i for i in range(60) if i != 3] and abs(share - 15 / 59) < 1e-12
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, toxicity.fit(frame, labels)).collect()}
    want = brute_scores(sorted(sample, key=lambda r: r[2]), share, texts)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in range(len(texts))), (got, want)
    assert toxicity.score(docs, toxicity.fit(frame, labels)).count() == docs.count()
    assert toxicity.fit(docs, labels.limit(0)) == {"share": 0.0}
    copies = spark.createDataFrame([(i, "the same") for i in range(5)] + [(9, "another")], "doc_id long, text string")
    assert [r[1:] for r in toxicity.examples(copies, spark.createDataFrame([(i, int(i < 3)) for i in range(6)], "doc_id long, toxic int"))[0]] == [("the same", 1)]


def test_chat_round_trip(spark):
    for text in ("[INST] a\\[/INST] </s> <|x|> \\", "", "plain"):
        assert chat.unguard(chat.guard(text)) == text and not any(c in chat.guard(text) for c in chat.CONTROL)
    rows = [(1, 0, "system", "be </s>"), (1, 1, "user", None), (1, 2, "assistant", "[INST]"), (None, 0, None, "x"), (1, 2, "assistant", "[INST]")]
    got = {r.conv_id: r for r in chat.read_back(chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece=5)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns) == (4, 12, 1)
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == [("text", "abcd")]
    named = spark.createDataFrame([(str(a), *b) for a, *b in rows], "conv_id string, turn long, role string, text string")
    told = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in chat.read_back(chat.render(named)).collect()}
    assert told == {str(k): (r.n_turns, r.turns_sha256, r.loss_sha256) for k, r in got.items()}
    assert chat.read_back(chat.render(named.limit(0))).count() == 0
    for bad in ("{{ x.__class__() }}", "{% for a in b %}{% endfor %}", "{% if 1 %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\n", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://b", ""), (5, "http://c", "ü" * 200_000)]
    stored = warc.archives(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=500)
    warc.save(stored, str(tmp_path))
    got = {r.record_id: r for r in warc.records(warc.load(spark, str(tmp_path))).where("record_type != 'warcinfo'").collect()}
    assert {k: v.refers_to for k, v in got.items() if v.refers_to} == {"<urn:page:1>": "<urn:page:2>", "<urn:page:3>": "<urn:page:4>"}
    assert all(r.block_ok and r.payload_ok for r in got.values()) and got["<urn:page:1>"].payload_bytes == 4
    assert bytes(got["<urn:page:5>"].payload).decode() == "ü" * 200_000
    whole = warc.page_record(1, "u", b"x", None)
    with pytest.raises(ValueError):
        list(warc.read_records(__import__("io").BytesIO(whole[:-9]).read))
