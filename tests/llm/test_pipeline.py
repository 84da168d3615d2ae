"""The pipeline's stages on a small table: each keeps the columns, and its decisions take effect."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import regex
import xxhash
import zstandard

import corpus_pipeline
from chronolake.llm import decontaminate, language, mixing, neardup, sharding
from tests.llm.test_operators import spark  # noqa: F401

DATA = "/root/testdata/sf0.001"


def test_stages(spark):  # noqa: F811
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0.5 * before < docs.count() <= before
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    mixed = corpus_pipeline.stored(corpus_pipeline.mixed(spark, docs, DATA), "mixed")
    want = mixing.replicate(docs).select("doc_id", "mix_copies").distinct().agg({"mix_copies": "sum"}).first()[0]
    assert mixed.columns == columns and mixed.count() == want
    out = corpus_pipeline.sharded(spark, mixed, DATA)
    assert out.count() == mixed.count() and out.select("shard", "slot").distinct().count() == out.count()


def _repeated(spark, pairs):  # noqa: F811
    return spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in pairs], "doc_id long, text string, lang string, source string, n_chars long")


def _pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_language_decides_by_row(spark):  # noqa: F811
    """One wrong row of a null or a repeated id leaves the id's good rows."""
    rng = random.Random(6)
    said = {"en": "the cat and this house with rain over hills".split(), "de": "der hund und das haus mit regen über berge".split()}
    good = [(i, " ".join(rng.choice(said[k]) for _ in range(60)), k) for i, k in enumerate(["en", "de"] * 60)]
    extra = [(None, good[2][1] + " cat", "en"), (None, "12 %", "en"), (7, "34 %", "en"), (900, None, "en")]
    got = _pairs(language.accepted(_repeated(spark, good + extra)))
    assert got == sorted([x[:2] for x in [*good, extra[0]]], key=str)


def test_benchmark_decides_by_row(spark):  # noqa: F811
    rng = random.Random(7)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(40))
    passage = " ".join(f"q{k}" for k in range(12))
    clean = [(None, text(), None), (None, text(), None), (5, text(), None), (6, None, None), (None, None, None)]
    bad = [(None, text() + " " + passage, None), (5, passage + " " + text(), None), (8, passage, None)]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = decontaminate.clean(_repeated(spark, clean + bad), items)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"] and _pairs(found) == sorted([x[:2] for x in clean], key=str)


def test_near_duplicates_keep_texts_of_one_id(spark):  # noqa: F811
    """Id 5 has two texts: one is a copy of id 3's, the other stands for id 9's."""
    rng = random.Random(8)
    a, b, c = (" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(3))
    docs = _repeated(spark, [(3, a, None), (5, a, None), (5, b, None), (5, b, None), (9, b + " more", None), (11, c, None), (None, c, None)])
    found = neardup.unique(docs)
    assert found.columns == docs.columns and _pairs(found) == sorted([(3, a), (5, b), (11, c), (None, c)], key=str)


def _letters(text):
    return regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower())


def plain_language(rows):
    """Rows that stay: dictionaries of passages of the other documents, joined by hand; the margin of the two smallest sizes."""
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    hash_of = lambda data: signed(xxhash.xxh64_intdigest(data, seed=42))
    texts = defaultdict(dict)
    for r in rows:
        if (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5) and r["lang"] is not None and r["text"]:
            texts[r["lang"]][hash_of(r["text"].encode())] = r["text"]
    coders = []
    for lang in sorted(texts):
        assert 3 * language.PASSAGES >= len(texts[lang])  # every text may be taken, so the smallest hashes are
        held = b""
        for h in sorted(texts[lang])[: language.PASSAGES]:
            text = texts[lang][h]
            at = hash_of(struct.pack("<q", h)) % (max(len(text) - language.PASSAGE, 0) + 1)
            piece = _letters(text[at : at + language.PASSAGE]).encode()
            if not held:
                held = piece
            elif len(held) + 1 + len(piece) <= language.DICTIONARY:
                held += b"\n" + piece
        coders.append(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False))
    out = []
    for r in rows:
        if r["text"] and any(map(str.isalpha, r["text"])):
            text = _letters(r["text"])
            first, second = sorted(sum(len(c.compress(text[k : k + language.PIECE].encode())) for k in range(0, len(text), language.PIECE)) for c in coders)[:2]
            out += [r] if (second - first) / first >= language.MARGIN else []
    return out


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_near_duplicates(rows):
    """All pairs of rows with an id, on their sets of five words; ids are unique here."""
    sets = {}
    for r in rows:
        w = regex.findall(r"[^\x20\x09-\x0D]+", _lower(r["text"]))
        n = min(5, len(w))
        if r["doc_id"] is not None and w:
            sets[r["doc_id"]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while moved := [(a, b) for a, b in links if comp[a] != comp[b]]:
        for a, b in moved:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return [r for r in rows if comp.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]


def plain_benchmark(rows, items):
    word = lambda text: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    windows = set()
    for w in map(word, items):
        windows |= runs(w, min(10, len(w))) if w else set()
    return [r for r in rows if not any(runs(word(r["text"]), n) & windows for n in range(1, 11))]


def plain_mixing(rows):
    """Every row as often as its number in [0, 1) says under the Poisson distribution of its source's rate."""
    size = lambda r: len((r["text"] or "").encode()) + 1
    mass = defaultdict(int)
    for r in rows:
        mass[r["source"]] += size(r)
    weight = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT) for s in mass}
    out = []
    for r in rows:
        rate = weight[r["source"]] / sum(weight.values()) * mixing.EPOCHS * sum(mass.values()) / mass[r["source"]]
        assert rate <= mixing.SINGLE
        name = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + hashlib.md5((r["text"] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies, p = 0, math.exp(-rate)
        below = p
        while below <= u:
            copies += 1
            p = p * rate / copies
            below += p
        out += [r] * copies
    return out


def plain_sharding(rows):
    """Groups of equal texts in the order of their md5, under the smallest capacity that needs no more shards than wanted."""
    key = lambda text: int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)
    size = lambda text: len((text or "").encode()) + 8
    groups = defaultdict(int)
    for r in rows:
        groups[key(r["text"])] += size(r["text"])

    def dealt(capacity):
        home, shard, held = {}, 0, 0
        for k in sorted(groups):
            if held + groups[k] > capacity:
                shard, held = shard + 1, 0
            home[k], held = shard, held + groups[k]
        return home

    low, high = max(groups.values()), sum(groups.values())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if max(dealt(mid).values()) < sharding.SHARDS else (mid + 1, high)
    home, slots, out = dealt(low), defaultdict(int), []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, key(r["text"]))):
        shard = home[key(r["text"])]
        out.append((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode()), "bytes", shard, slots[shard], None))
        slots[shard] += 1
    return out


def test_run_is_as_plain_stages(spark, tmp_path):  # noqa: F811
    """The whole pipeline's rows against the five stages written out in plain Python."""
    docs, items = pq.read_table(f"{DATA}/documents.parquet"), pq.read_table(f"{DATA}/benchmark.parquet")
    rows = docs.to_pylist()
    like = lambda k, **more: rows[k] | more
    passage = items["text"][0].as_py()
    rows += [like(3, doc_id=90001, text=None), like(4, doc_id=90002, text=""), like(5, doc_id=90003, text="12 % 7"), like(6, doc_id=90004), like(7, doc_id=90005, text=rows[7]["text"] + " end"), like(8, doc_id=90006, text=rows[8]["text"] + " " + passage.upper()), like(9, doc_id=None, text=rows[9]["text"][::-1], source=None)]
    pq.write_table(pa.Table.from_pylist(rows, docs.schema), tmp_path / "documents.parquet")
    pq.write_table(items, tmp_path / "benchmark.parquet")
    told = plain_language(rows)
    apart = plain_near_duplicates(told)
    clean = plain_benchmark(apart, [t.as_py() for t in items["text"]])
    assert len(rows) > len(told) > len(apart) > len(clean) > 50 and {90001, 90002, 90003}.isdisjoint(r["doc_id"] for r in told)
    mixed = plain_mixing(clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_sharding(mixed)))
