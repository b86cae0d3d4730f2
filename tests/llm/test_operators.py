"""Every operator against a brute-force version on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from agrispark.llm import katz, language, media, mixing, neardup, phrases, pieces, quality, repeats, tokencount
from agrispark.llm.components import components
from agrispark.llm.folds import fold
from agrispark.llm.shingles import bands, shingle_set, signature
from agrispark.llm.words import WordHashes
from rows import awkward, prose

PIECES, MERGES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
RAW = awkward()


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def words_of(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def test_word_hashes_tell_words_apart():
    texts = [(r[1] or "").encode() for r in RAW] + [b"A a", b"", "é É".encode()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes, first = WordHashes(lower=True).of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    found = {}
    for t, i, j in zip(texts, first[:-1], first[1:]):
        words = t.lower().split()
        assert len(words) == j - i
        for w, h in zip(words, hashes[i:j].tolist()):
            assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found)


def test_pieces_equal_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(pieces.round_trip(docs, PIECES))
    for doc_id, text, *_ in RAW:
        assert got[doc_id]["ids"] == (None if text is None else library.encode(text))
        assert got[doc_id]["same"] == ("▁" not in (text or ""))
    model = pieces.PieceModel(PIECES)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "in", "  ", "\n", "é", "▁", chr(rng.randrange(32, 0x2FFF)), "the", "ing"]) for _ in range(rng.randrange(25)))
        assert model.encode([text])[0].tolist() == library.encode(text)


def test_separate_encoding_and_decoding(docs):
    coded = pieces.decode(pieces.encode(docs.select("doc_id", "text", "ids"), PIECES), PIECES)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    assert coded.filter(~F.col("text").contains("▁") & ~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0


def test_unigram_states_are_the_best_sums():
    model = pieces.PieceModel(PIECES)
    model.bpe = False
    model.scores = {i: -len(t) ** 0.5 - (i % 7) / 3 for t, i in model.ids.items()}
    for word, ids in model.encode_sorted(sorted(["▁the", "▁then", "▁thing", "▁things", "ing"])):
        best = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                if word[i:j] in model.ids:
                    best[j] = max(best[j], best[i] + model.scores[model.ids[word[i:j]]])
        assert "".join(model.texts[i] for i in ids) == word
        assert math.isclose(sum(model.scores[i] for i in ids), best[-1])


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MERGES)
    got = by_id(tokencount.count_tokens(docs, MERGES, public_tokenizers.PATTERN, 1024))
    for doc_id, text, *_ in RAW:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = got[doc_id]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def level_targets(sizes, weights, budget, passes):
    """Shares by weight, again and again for what the full ones leave."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if passes * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_its_targets(docs):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in RAW:
        sizes[r[3]] += len(words_of(r[1]))
    wanted = level_targets(sizes, mixing.WEIGHTS, mixing.BUDGET, mixing.PASSES)
    taken, largest = Counter(), Counter()
    source = {r[0]: r[3] for r in RAW}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 2 * r["size"] and math.isclose(r["target"], wanted[s]) and r["source_size"] == sizes[s]
    assert len(got) == len(RAW)
    slack = 2 * max(largest.values())
    assert all(abs(taken[s] - wanted[s]) <= slack for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mixed_documents_repeat(docs):
    times = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: n for k, n in times.items() if n})


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(docs, size):
    sets = {}
    for doc_id, text, *_ in RAW:
        w = words_of(text, lower=True)
        k = min(size, len(w))
        sets[doc_id] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in neardup.near_duplicates(docs, size, 80).collect():
        d = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), find(d), find(d) == d)
    kept = neardup.without_copies(docs, size, 80)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [d for d in ids if find(d) == d]


def test_low_bytes_of_a_band_are_no_shared_bucket(spark):
    """Nodes 1 and 2 meet in band 5 only, though the low bytes of all bands agree; 3 and 4 meet in bands 2 and 5."""
    def row(node, band, apart):
        names = [k if k in apart else 1000 * node + k for k in range(28)]
        return names[band], band, node, 100, bytes(112), names, node, 1

    def found(*rows):
        frame = spark.createDataFrame(list(rows), "bucket long, band int, node long, n long, sign binary, bands array<long>, root long, n_root long")
        return [tuple(r) for r in neardup._across(frame, 80).collect()]

    assert found(row(1, 5, {5}), row(2, 5, {5})) == [(1, 2)]
    assert found(row(3, 5, {2, 5}), row(4, 5, {2, 5})) == []
    assert found(row(3, 2, {2, 5}), row(4, 2, {2, 5})) == [(3, 4)]


def test_a_large_group_of_near_copies_is_one_class(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(neardup, "CHECK_BLOCK", 4)
    rng = random.Random(3)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(0, 14)):
            w[at] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(60):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame, 2, 80).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 150, 150))
    x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
    assert abs((signature(x) == signature(y)).mean() - 0.7) < 0.15
    assert (signature(x) == signature(x[::-1])).all() and len(bands(signature(x))) == 28
    assert len(shingle_set(np.zeros(0, np.uint64), 2)) == 0 and len(shingle_set(np.ones(1, np.uint64), 2)) == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}


@pytest.mark.parametrize("heavy", [4096, 1])
def test_repeats_equal_brute_force(docs, heavy, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    first = {}
    for doc_id, text, *_ in sorted(RAW, key=lambda r: r[0]):
        w = words_of(text)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p:p + 50]), doc_id)
    got = by_id(repeats.removals(docs))
    lost = 0
    for doc_id, text, *_ in RAW:
        w = words_of(text)
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p:p + 50])] < doc_id:
                gone.update(range(p, p + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        r = got[doc_id]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        lost += len(gone)
    assert lost > 1000
    rest = repeats.without_repeats(docs)
    assert rest.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in rest.collect()}
    for doc_id, text, *_ in RAW:
        r = got[doc_id]
        if not r["n_removed"]:
            assert texts[doc_id] == text
        elif r["n_removed"] == r["n_words"]:
            assert doc_id not in texts
        else:
            assert hashlib.sha256(texts[doc_id].encode()).hexdigest() == r["kept_sha256"]


def test_katz_equals_brute_force_and_adds_up_to_one(docs, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 3000)
    tokens = {r[0]: [*words_of(r[1], lower=True), "end"] for r in RAW}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    single, pair = Counter(), Counter()
    for d, t in tokens.items():
        if not held[d]:
            single.update(t)
            pair.update(zip(["start", *t[:-1]], t))
    after = defaultdict(dict)
    for (h, w), r in pair.items():
        after[h][w] = r
    n, v = sum(single.values()), len(single)

    def losses(counts):
        of = Counter(counts.values())
        return katz.discounts({r: of[r] for r in range(1, katz.CUT + 2)})

    low, high = losses(single), losses(pair)
    star = lambda loss, r: r - loss[min(r, katz.CUT + 1)]
    rest = 1 - sum(star(low, r) for r in single.values()) / n
    lower = lambda w: star(low, single[w]) / n if single[w] else rest

    def share(w, h):
        if h not in after:
            return lower(w)
        c = sum(after[h].values())
        if w in after[h]:
            return star(high, after[h][w]) / c
        left = 1 - sum(star(high, r) for r in after[h].values()) / c
        return left / (1 - sum(lower(x) for x in after[h])) * lower(w)

    for h in [*list(after)[:12], "start", "never seen"]:
        assert math.isclose(sum(share(w, h) for w in single) + share("never seen", h), 1.0)
    for d, r in by_id(katz.scores(docs, fold(F.col("doc_id"), 5) == 1)).items():
        t = tokens[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(t), sum(w in single for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert math.isclose(r["score"], sum(math.log10(share(w, h)) for h, w in zip(["start", *t[:-1]], t)))


def test_fingerprints_of_texts_and_edits(docs):
    got = by_id(phrases.fingerprint_pairs(docs))
    ordered = sorted(RAW, key=lambda r: r[0])
    for k, (doc_id, text, *_) in enumerate(ordered):
        text, follower = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + follower[:quarter]
        r = got[doc_id]
        own, new = phrases.fingerprint(text), phrases.fingerprint(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"], r["near_edited"]) == (own, new, phrases.likeness(own, new))
        assert r["near_next"] == phrases.likeness(own, phrases.fingerprint(follower))


def plain_fingerprint(text):
    """Phrases by Lempel and Ziv's rule, one start after the other, and the least hash of every bin in Python integers."""
    phrases, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in phrases:
            end += 1
        phrases.add(text[at:end])
        at = end
    least = {}
    for p in phrases:
        h = xxhash.xxh3_64_intdigest(p)
        least[h >> 57] = min(h, least.get(h >> 57, h))
    folded = {b: (h >> 25) & 0xFFFFFFFF for b, h in least.items()}
    return {b: (m ^ (m >> 16)) & 0xFFFF for b, m in folded.items()}


def test_fingerprints_equal_plain_python(docs):
    got = by_id(phrases.fingerprint_pairs(docs))
    ordered = sorted(RAW, key=lambda r: r[0])
    of = lambda f: {b: int(f[4 * b:4 * b + 4], 16) for b in range(128) if f[4 * b:4 * b + 4] != "----"}
    alike = lambda a, b: sum(a.get(k) == b.get(k) for k in {*a, *b}) / len({*a, *b}) if a or b else 1.0
    for k, (doc_id, text, *_) in enumerate(ordered):
        text, follower = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        quarter = len(text) // 4
        own, new, after = (plain_fingerprint(t) for t in (text, text[:len(text) - quarter] + follower[:quarter], follower))
        r = got[doc_id]
        assert of(r["fingerprint"]) == own and of(r["edited_fingerprint"]) == new
        assert math.isclose(r["near_edited"], alike(own, new)) and math.isclose(r["near_next"], alike(own, after))


def test_phrases_are_the_shortest_new_runs():
    seen = set()
    assert phrases.parse("abababa", seen) == "" and seen == {"a", "b", "ab", "aba"}
    assert phrases.likeness(phrases.fingerprint(""), phrases.fingerprint("")) == 1.0
    assert phrases.likeness(phrases.fingerprint(""), phrases.fingerprint("abc")) == 0.0


def decoded(image):
    """Samples of an 8-bit grey PNG of unfiltered rows, by the format's own rules."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(image):
        n = int.from_bytes(image[at:at + 4], "big")
        kind, data, check = image[at + 4:at + 8], image[at + 8:at + 8 + n], image[at + 8 + n:at + 12 + n]
        assert zlib.crc32(kind + data) == int.from_bytes(check, "big")
        chunks.append((kind, data))
        at += 12 + n
    kinds = [k for k, _ in chunks]
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    width, height, depth, colour = (int.from_bytes(chunks[0][1][i:j], "big") for i, j in ((0, 4), (4, 8), (8, 9), (9, 10)))
    assert (depth, colour) == (8, 0)
    raw = zlib.decompress(b"".join(d for k, d in chunks if k == b"IDAT"))
    rows = [raw[i * (width + 1):(i + 1) * (width + 1)] for i in range(height)]
    assert len(raw) == height * (width + 1) and all(r[0] == 0 for r in rows)
    return b"".join(r[1:] for r in rows)


def test_stored_media_read_back(docs):
    got = by_id(media.document_media(docs))
    assert len(got) == len(RAW)
    for doc_id, text, *_ in RAW:
        data = (text or "").encode()
        payload = data + bytes(64 if not data else -len(data) % 64)
        image = media.to_png(payload)
        assert decoded(image) == media.from_png(image) == payload
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(payload), len(image))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(image).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        share = [n / len(payload) for n in Counter(payload).values()]
        mean = sum(payload) / len(payload)
        spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
        alike = sum(a == b for a, b in zip(payload, payload[1:])) / (len(payload) - 1)
        bits = max(0.0, -sum(p * math.log2(p) for p in share))
        size, *values = r["feature"].split(";")
        assert size == f"64x{len(payload) // 64}"
        assert [v.split("=")[0] for v in values] == ["mean", "sd", "bits", "alike"]
        assert all(abs(float(v.split("=")[1]) - w) < 1e-4 for v, w in zip(values, (mean, spread, bits, alike)))
        runs = [" ".join(line.split()) for line in (text or "").split("\n")]
        before = [x for x in runs[:len(runs) // 2] if x]
        filled = [x for x in runs if x]
        assert (r["position"], r["tail_position"], r["items"]) == (len(before), len(filled) + 1, len(filled) + 2)
        assert (r["caption"], r["tail_caption"]) == (f"text of {len(data)} bytes", "its last samples")
        assert r["text_chars"] == sum(map(len, filled))
    damaged = bytearray(media.to_png(bytes(128)))
    damaged[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(damaged))


def test_sequences_keep_positions_and_captions(spark):
    digest = "d" * 64
    html = (
        f"<body>one &amp; <b>two</b><figure><img src='{media.SCHEME}{digest}' alt='x'><figcaption>the  caption</figcaption></figure>"
        "<script>no</script><p>three</p><img src='http://e/x.png' alt='alone'><p></body>"
    )
    pages = spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id long, html string")
    table = spark.createDataFrame([(digest, 7)], "digest string, width int")
    got = {r["page_id"]: r["sequence"] for r in media.resolve(media.parse_sequences(pages), table, ["page_id"]).collect()}
    assert [(i["position"], i["kind"], i["text"], i["caption"], i["media"] and i["media"]["width"]) for i in got[1]] == [
        (0, "text", "one & two", None, None), (1, "media", None, "the caption", 7), (2, "text", "three", None, None), (3, "media", None, "alone", None),
    ]
    assert got[2] == [] and [i["text"] for i in got[3]] == ["plain"]


def test_missing_and_shared_digests_stay_in_place(spark):
    """Several media a page, one of them twice, one that no row has; pages with a null key."""
    image = lambda d, c: f"<figure><img src='{media.SCHEME}{d}'><figcaption>{c}</figcaption></figure>"
    html = image("a" * 64, "first") + "<p>between</p>" + image("f" * 64, "missing") + image("b" * 64, "third") + image("a" * 64, "again")
    pages = spark.createDataFrame([(1, html), (None, html), (7, image("b" * 64, "alone"))], "page_id long, html string")
    table = spark.createDataFrame([("a" * 64, 1, "x"), ("b" * 64, 2, "y")], "digest string, width int, name string")
    got = media.resolve(media.parse_sequences(pages), table, ["page_id"]).collect()
    assert len(got) == 3
    for r in got:
        items = [(i["position"], i["kind"], i["caption"], i["media"] and tuple(i["media"])) for i in r["sequence"]]
        assert items == ([(0, "media", "alone", (2, "y"))] if r["page_id"] == 7 else [
            (0, "media", "first", (1, "x")), (1, "text", None, None), (2, "media", "missing", None), (3, "media", "third", (2, "y")), (4, "media", "again", (1, "x")),
        ])


def test_languages_are_told_apart(spark):
    rng = random.Random(6)
    letters = {"aa": "etaoin", "bb": "shrdlu", "cc": "äöüßxq", "dd": "жзийкл"}
    rows = [(i, prose(rng, rng.randint(5, 60), letters[k]), k) for i, k in enumerate(sorted(letters) * 60)]
    rows += [(900, None, "aa"), (901, "12 ...", None), (902, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predicted(frame, fold(F.col("doc_id"), 4) == 2).collect()}
    held = [(got[i]["lang_pred"], k) for i, _, k in rows[:240] if got[i]["held_out"]]
    assert held and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["ambiguous"] for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def plain_trigrams(text):
    """Buckets of byte trigrams in Python integers: upper case folded, whatever is no letter below 128 is one break."""
    code = [32, *((b | 32 if chr(b).isalpha() else 32) if b < 128 else b for b in text.encode()), 32]
    out = Counter()
    for a, b, c in zip(code, code[1:], code[2:]):
        if b != 32:
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
            h ^= h >> 15
            out[(h * 0x2C1B3C6D % 2**32) >> 20] += 1
    return out


def test_decoding_equals_plain_python(spark):
    """Counts, bit classifiers and loss-based decoding of three languages and of texts that are all alike."""
    rng = random.Random(21)
    letters = {"aa": "etaoin", "bb": "shrdlu", "cc": "äöüßxq"}
    rows = [(i, prose(rng, rng.randint(1, 12), letters[k]), k) for i, k in enumerate(sorted(letters) * 12)]
    rows += [(100 + i, "tie tie", k) for i, k in enumerate(sorted(letters) * 2)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    counts = defaultdict(Counter)
    for i, text, k in rows:
        if i not in held:
            counts[k].update(plain_trigrams(text))
    names = sorted(counts)
    share = {k: [(counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * 4096) for b in range(4096)] for k in names}
    words = {names[0]: (1, 1, 1), names[1]: (-1, 1, -1), names[2]: (-1, -1, 1)}
    weight = []
    for bit in range(3):
        ones, zeros = ([k for k in names if words[k][bit] == v] for v in (1, -1))
        mean = lambda of, b: sum(share[k][b] for k in of) / len(of)
        weight.append([math.log(mean(ones, b)) - math.log(mean(zeros, b)) for b in range(4096)])
    assert sorted(map(tuple, language.codewords(3).T.tolist())) == sorted(zip(*(words[k] for k in names)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in language.predicted(frame, fold(F.col("doc_id"), 4) == 2).collect()}
    for i, text, _ in rows:
        grams = plain_trigrams(text)
        bits = [sum(n * w[b] for b, n in grams.items()) / math.sqrt(max(sum(grams.values()), 1)) for w in weight]
        loss = {k: sum(math.log1p(math.exp(-b * s)) for b, s in zip(bits, words[k])) for k in names}
        best = min(names, key=lambda k: (round(loss[k], 9), k))
        assert got[i]["lang_pred"] == best and got[i]["held_out"] == (i in held)
        assert math.isclose(got[i]["score"], 1 / sum(math.exp(loss[best] - loss[k]) for k in names), rel_tol=1e-9)


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 7, 20):
        code = language.codewords(k)
        agree = code @ code.T
        assert len({tuple(r) for r in code}) == k and (np.abs(code.sum(0)) < k).all()
        if k > 2:
            np.fill_diagonal(agree, -code.shape[1])
            assert (code.shape[1] - agree.max()) / 2 >= 2 ** (k - 2) * (k <= 7) or k > 7


def test_quality_is_learnt_and_calibrated(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, rng.randint(5, 60)) if good else " ".join([prose(rng, 1)] * rng.randint(5, 60))))
        if i % 3:
            labels.append((i, int(good)))
    truth = {i: int(len(set(t.split())) > 1) for i, t in rows}
    frame = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (3, None), (1, labels[0][1])], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.scored(frame, marks, 0.3).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert len(got) == 902 and sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert math.isclose(got[5000]["score"], got[5001]["score"])
    none = quality.scored(frame, marks.filter("false"), 0.3).collect()
    assert {r["score"] for r in none} == {0.5}


def test_pooling_is_monotone():
    knots, values = quality.pooled(np.arange(5.0), np.array([1.0, 0.0, 3.0, 1.0, 4.0]), np.array([2, 2, 4, 4, 4]))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all() and values[-1] == 1.0 and values[0] == 0.25


def test_a_prefix_repeated_within_a_document_is_heavy(spark):
    """Two documents share a prefix that one of them repeats a thousand times: its suffixes are no light group."""
    rng = random.Random(6)
    passage = prose(rng, 60)
    texts = [(1, passage + " " + prose(rng, 20)), (2, " ".join([passage] * 6000))]
    outlines = repeats._outlines(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("copy", F.lit(False))
    assert any(r["is_heavy"] for r in repeats._shared_prefixes(outlines).collect())
    frame = spark.createDataFrame([texts[0], (2, " ".join([passage] * 2)), (3, "a " * 9000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.removals(frame).collect()}
    assert got == {1: (80, 0), 2: (120, 120), 3: (9000, 0)}


def test_suffixes_of_one_document_leave_in_batches(monkeypatch):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(repeats, "FLUSH", 10)
    words = WordHashes(seed=17, lower=False).of(np.frombuffer(b"a " * 500, np.uint8), np.array([0, 1000]))[0]
    anchor = int(repeats.anchors(words)[0].view(np.int64)[0])
    row = pa.RecordBatch.from_pydict({"doc_id": [1], "tag": [1], "packed": [zstandard.compress(b"a " * 500)], "light": [[anchor]], "heavy": [[]]})

    class Chosen:
        def mapInArrow(self, collected, schema):
            return list(collected(iter([row])))

    assert max(len(b) for b in repeats._suffixes(Chosen())) <= 10
