"""The pipeline's rows against a chain of plain Python: only the found languages come from the operator."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from agrispark.llm import language
from agrispark.llm.folds import fold
from rows import prose

LETTERS = {"aa": "etaoin", "bb": "shrdlu"}


def planted(seed=12):
    """(doc_id, text, lang, source, n_chars): plain texts, exact and near copies, shared passages, texts without letters."""
    rng = random.Random(seed)
    passage = {k: prose(rng, 80, v) for k, v in LETTERS.items()}
    rows = []
    for i in range(70):
        lang = "aa" if i % 2 else "bb"
        text = prose(rng, rng.randint(20, 160), LETTERS[lang])
        if i % 9 == 4:
            text += " " + passage[lang] + "\n" + prose(rng, 15, LETTERS[lang])
        rows.append([text, lang])
    for i in range(0, 24, 2):
        words = rows[i][0].split(" ")
        words[len(words) // 2] = "changed"
        rows.append([" ".join(words) if i % 4 else rows[i][0], rows[i][1]])
    rows += [[passage["aa"], "aa"], [None, "aa"], ["", None], ["123 ... 456", "bb"], [" \n ", None]]
    rng.shuffle(rows)
    return [(3 * i + 1, t, lang, ("web", None, "books", "wiki")[i % 4], len(t or "")) for i, (t, lang) in enumerate(rows)]


def without_copies(rows):
    sets = {}
    for r in rows:
        w = r[1].encode().lower().split()
        k = min(5, len(w))
        sets[r[0]] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
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
    return [r for r in rows if find(r[0]) == r[0]]


def without_repeats(rows):
    first = {}
    for r in sorted(rows):
        w = r[1].split()
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p:p + 50]), r[0])
    out = []
    for doc_id, text, *rest, n_chars in rows:
        w, gone = text.split(), set()
        for p in range(len(w) - 49):
            if first[tuple(w[p:p + 50])] < doc_id:
                gone.update(range(p, p + 50))
        if len(gone) < len(w) or not gone:
            kept = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
            out.append((doc_id, kept, *rest, len(kept) if gone else n_chars))
    return out


def mixed(rows):
    """Documents by virtual finish time up to 150 % of all words, weights 5, 2, 1 by source, two passes at most."""
    sized = [(hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest(), r[0], len(r[1].split()), r) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    size, served, queue = Counter(), Counter(), []
    for _, _, n, r in sized:
        size[r[3]] += n
    for name, doc_id, n, r in sorted(sized, key=lambda x: x[:3]):
        s = r[3]
        served[s] += n
        queue += [((served[s] + k * size[s]) / weight[s], s or "", s is None, k, name, doc_id, n, r) for k in range(2)]
    left, out = 1.5 * sum(size.values()), []
    for *_, n, r in sorted(queue, key=lambda x: x[:7]):
        left -= n
        if left >= 0 and n:
            out.append(r)
    return out


def test_rows_equal_plain_python(spark, tmp_path):
    import sentencepiece

    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in language.predicted(frame, fold(F.col("doc_id"), 4) == 2).collect()}
    known = [r for r in rows if found[r[0]]["lang_pred"] != "und" and not found[r[0]]["ambiguous"]]
    assert all(r[0] not in {k[0] for k in known} for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert len(known) > 70
    unique = without_copies(known)
    cut = without_repeats(unique)
    taken = mixed(cut)
    assert len(unique) < len(known) and sum(len(r[1]) for r in cut) < sum(len(r[1]) for r in unique) and len(taken) > len(cut)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = Counter((r[0], r[2], r[3], tuple(library.encode(r[1])), hashlib.sha256(r[1].encode()).hexdigest()) for r in taken)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in got) == wanted
    assert all(r["same"] for r in got)


def test_each_stage_keeps_every_clean_document(spark):
    """Documents without copies, repeats or odd letters pass all filtering stages."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 60, LETTERS["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb", "s", 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, "")
        seen[name] = frame.count()
    assert set(seen.values()) == {60}
