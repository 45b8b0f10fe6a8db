"""The Kneser-Ney model against a plain-Python one, and what the classification gives for odd rows."""

import collections
import math
import zlib

import pytest

from lectern.llm import quality

ORDER = quality.ORDER


def _brute(texts):
    """P(symbol | up to ORDER-1 symbols before it) of an interpolated modified Kneser-Ney model, by dictionaries."""
    pad = ("^",) * (ORDER - 1)
    counts = {ORDER: collections.Counter()}
    for t in texts:
        s = pad + tuple(t)
        counts[ORDER].update(s[i : i + ORDER] for i in range(len(t)))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    ds, total, freed = {}, {}, {}
    for k, c in counts.items():
        n = [0] + [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        ds[k] = []
        for j in (1, 2, 3):
            if n[1] and n[2] and n[j]:
                y = n[1] / (n[1] + 2 * n[2])
                ds[k].append(min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.0), float(j)))
            else:
                ds[k].append(0.5 * j)
        total[k], freed[k] = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[k][g[:-1]] += v
            freed[k][g[:-1]] += ds[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        k, lower = len(g), p(g[1:])
        if not total[k][g[:-1]]:
            return lower
        v = counts[k][g]
        over = max(v - ds[k][min(v, 3) - 1], 0.0) if v else 0.0
        return (over + freed[k][g[:-1]] * lower) / total[k][g[:-1]]

    def entropy(t):
        s = pad + tuple(t)
        return -sum(math.log(p(s[i : i + ORDER])) for i in range(len(t))) / len(t)

    return entropy


EN = ["the rain in spain", "a plain train again", "rain again and again", "the the the", "spain is in the rain", "aaa bbb ccc ddd", "x"]
RU = ["дождь идёт и идёт", "идёт поезд", "мама мыла раму", "раму мыла мама", "поезд дождя"]
ROWS = [(i, t, "en") for i, t in enumerate(EN)] + [(20 + i, t, "ru") for i, t in enumerate(RU)] + [
    (40, "the train", "en"), (41, "поезд в дождь", "ru"), (42, "ждоьд ёдти", "ru"), (43, "中文文本", "zh"), (44, "文本中文", None),
    (45, None, "en"), (46, "", "ru"), (47, "the train", "en"), (None, "rain", "en"), (None, None, None), (48, "\U0001f600" * 5, "*"),
    (2**60 + 1, "a rain", "en"),
]


def _frames(spark):
    docs = spark.createDataFrame([(*r, "k", 3, 1.0) for r in ROWS], "doc_id long, text string, lang string, model string, block int, a double")
    labels = spark.createDataFrame([(r[0], 1) for r in ROWS if r[0] is not None and r[0] < 40] + [(45, 1), (40, 0), (41, None), (None, 1)], "doc_id long, quality int")
    return docs.repartition(4), labels


def test_perplexities_equal_a_plain_model(spark):
    docs, labels = _frames(spark)
    got = quality.perplexities(docs, labels).collect()
    assert len(got) == len(ROWS)
    fit = {lang: [t for i, t, x in ROWS if i is not None and i < 40 and x == lang and zlib.crc32(t.encode()) % 5] for lang in ("en", "ru")}
    models = {lang: _brute(texts) for lang, texts in fit.items()} | {"*": _brute(fit["en"] + fit["ru"])}
    text = {r[0]: r for r in ROWS if r[0] is not None}
    for r in got:
        if r.doc_id is None:
            continue
        _, t, lang = text[r.doc_id]
        assert r.model == (lang if lang in fit else "*")
        if t:
            assert r.log_perplexity == pytest.approx(models[r.model](t), rel=1e-9)
        else:
            assert r.log_perplexity is None
        trusted = r.doc_id < 40 or r.doc_id == 45
        assert r.role == ((1 if zlib.crc32((t or "").encode()) % 5 else 2) if trusted else 0)
    scores = {r.doc_id: r.log_perplexity for r in got}
    assert scores[41] < scores[42] and scores[40] == scores[47]  # letters of one script are told apart; ties


def test_tables_grow_with_the_corpus_and_sum_to_one(spark):
    docs, _ = _frames(spark)
    texts = [t for _, t, x in ROWS if x == "en" and t]
    alphabet = sorted(set("".join(texts)))
    p = _brute(texts)
    total = sum(math.exp(-len("the" + c) * p("the" + c) + 3 * p("the")) for c in alphabet)
    assert total < 1 and total > 0.9  # the rest belongs to the code points not seen


def test_classify(spark):
    docs, labels = _frames(spark)
    got = quality.classify(docs, labels, 0.9).collect()
    assert len(got) == len(ROWS) and all(r.kept for r in got if r.perplexity is None)
    assert {r.doc_id for r in got if r.perplexity is None} == {45, 46, None}
    for r in got:
        assert r.perplexity is None or r.kept == (math.log(r.perplexity) <= math.log(r.threshold) + 1e-12)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 40) >= 10
    none = quality.classify(docs, labels.where("quality = 7")).collect()
    assert len(none) == len(ROWS) and all(r.kept and r.perplexity is None for r in none)
    assert quality.classify(docs.limit(0), labels).count() == 0
