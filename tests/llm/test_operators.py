"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from tessella.llm import exact_dedup, lm_score, mixing, near_dedup, pii, quality, toxicity, url_filter
from tessella.llm.shingles import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, block string, kept boolean, rid long, stratum string, label long"
random.seed(3)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, 0, "n", "b", True, 7, "x", 1)


BASE = prose(120)
LONG = prose(30_000)
ROWS = [
    row(1, BASE), row(2, BASE.upper()), row(3, BASE + " zz"), row(4, None), row(5, ""), row(6, " \n "), row(7, LONG, None, None), row(8, LONG + " end", "de", "s1"),
    row(9, prose(60), None), row(10, "one two three"), row(11, "one two three"), row(12, "x" * 9000), row(13, "x" * 8999 + "y"), row(14, prose(80), "fr", "s2"), row(15, "Éa éa ÉA"),
]
ODD = [*ROWS, row(1, "another text of id one"), row(None, BASE), row(None, None), row(14, ROWS[13][1], "fr", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_exact_groups(docs, odd):
    for df, rows in ((docs, ROWS), (odd, ODD)):
        got = exact_dedup.exact_groups(df, block_bytes=64).collect()
        groups = collections.defaultdict(list)
        for r in rows:
            groups[ascii_lower(r[1])].append(r[0])
        want = collections.Counter()
        for t, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            for i in ids:
                want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        kept = exact_dedup.exact_dedup(df, block_bytes=64)
        assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_hot_blocks(spark, monkeypatch):
    rows = [(i, "same " * 50) for i in range(400)] + [(1000 + i, "same " * 50 + str(i)) for i in range(5)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=32).collect()
    assert sorted(r.group_size for r in got) == [1] * 5 + [400] * 400 and {r.keep_id for r in got if r.group_size > 1} == {399}


def shingle_counts(text):
    w = words_of(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(rows):
    sets = [shingle_counts(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both and both >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = root[a], root[b]
                root = [y if z == x else z for z in root]
    return root


def test_near_classes(spark, docs, odd):
    for df, rows in ((docs, ROWS), (odd, ODD)):
        got = near_dedup.near_groups(df).collect()
        sizes = collections.Counter(brute_classes(rows))
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(sizes)
        assert collections.Counter(r.class_size for r in got) == collections.Counter(sizes[x] for x in brute_classes(rows))
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(brute_classes(ODD)))


def test_near_classes_do_not_depend_on_other_rows(spark):
    """The class of 9 and 3 is that of 3, whatever ids are repeated or null elsewhere and however rows are dealt out."""
    rows = [row(9, BASE), row(5, prose(70)), row(3, BASE + " end"), row(11, BASE + " other"), *(row(100 + i, prose(60)) for i in range(20))]
    for extra in ([], [row(5, prose(50))], [row(None, prose(50))], [row(3, BASE + " zz")]):
        for parts in (1, 7):
            got = near_dedup.near_groups(spark.createDataFrame(rows[::-1] + extra, SCHEMA).repartition(parts)).collect()
            mine = [r for r in got if r.doc_id in (3, 9, 11)]
            assert {r.class_id for r in mine} == {3} and [r.doc_id for r in mine if r.kept] == [3]
    texts = {near_dedup.near_dedup(spark.createDataFrame(x, SCHEMA)).where("doc_id = 3").first().text for x in ([rows[2], row(3, BASE + " zz"), *rows], [*rows[::-1], row(3, BASE + " zz")])}
    assert len(texts) == 1


def test_near_graded_group(spark, monkeypatch):
    """A group whose members differ by degrees, in small blocks: no link is lost."""
    monkeypatch.setattr(near_dedup, "PIVOTS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    base, rows = BASE.split(), []
    for i in range(60):
        w = list(base)
        for _ in range(i % 7):
            w[random.randrange(len(w))] = f"edit{i}"
        rows.append(row(i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    root = brute_classes(rows)
    want = {r[0]: min(s[0] for s, y in zip(rows, root, strict=True) if y == x) for r, x in zip(rows, root, strict=True)}
    assert got == want


def test_dart_signatures_estimate_similarity():
    import numpy as np

    from tessella.llm.shingles import elements, word_hashes

    a, b = prose(600).split(), None
    b = a[:540] + prose(60).split()
    w = [x.encode() for x in a + b]
    e, n = elements(word_hashes(w), np.array([len(a), len(b)]))
    sig = near_dedup.signatures(e, n, 1024)
    x, y = set(e[: n[0]].tolist()), set(e[n[0] :].tolist())
    assert (sig > 0).all() and abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.05


def repeat_words(w):
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_quality(spark, docs, odd):
    good = [row(100 + i, prose(60 + i % 20)) for i in range(900)]
    junk = [row(2000 + i, " ".join(w + "***" for w in prose(60).split())) for i in range(40)]
    df = spark.createDataFrame(ODD + good + junk, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk] + [(None, 1, 0), (5, None, None), (100, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    from tessella.llm.common import RID

    got = quality.judged(df.withColumn(RID, F.monotonically_increasing_id()), labels).collect()
    want = collections.Counter()
    for r in ODD + good + junk:
        t = r[1] or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(w))
        want[(r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {r[0] for r in junk} and len(kept & {r[0] for r in good}) >= 0.96 * 900
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns and out.count() == sum(r.kept for r in got)
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_of_small_strata(spark):
    sizes = {"de": 400, "es": 150, "it": 120}  # de alone, es and it pooled; pt has no labels
    good = [row(1000 * k + i, prose(60), lang) for k, (lang, n) in enumerate(sizes.items(), 1) for i in range(n)]
    junk = [row(9000 + i, " ".join(w + "***" for w in prose(60).split()), lang) for i, lang in enumerate([*sizes, "pt"] * 3)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(good + junk, SCHEMA), labels).collect()}
    assert kept & {r[0] for r in junk} == {r[0] for r in junk if r[2] == "pt"}
    assert len(kept & {r[0] for r in good}) >= 0.98 * len(good)


def test_binomial_bound(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(500, 3), (2000, 12), (100, 0), (50, 40)], "n long, k long")
    for r in df.select("n", "k", quality.binomial_cdf(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == (1.0 if r.k > r.n * 0.01 else pytest.approx(want))


def test_toxicity(spark, docs, odd):
    bad = ["vile", "rotten", "nasty", "filthy"]
    rows, labels = [], []
    for i in range(600):
        w = prose(40).split()
        if i % 6 == 0:
            for k in range(1 + i % 5):
                w[random.randrange(40)] = bad[(i + k) % 4]
        rows.append(row(i, " ".join(w)))
        if i < 400:
            labels.append((i, 1, int(i % 6 == 0)))
    labels += [(None, 1, 1), (3, 1, None), (0, 1, 0)]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = toxicity.train(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df, models).collect()}
    truth = {r[0]: bool(set(bad) & set(r[1].split())) for r in rows}
    assert sum(got[i].toxic == truth[i] for i in range(400, 600)) >= 196  # held out
    assert all(got[i].toxic for i in got if got[i].severe)
    assert models[1]["extra"] and len(toxicity.score(odd, models).collect()) == len(ODD)
    none = toxicity.train(df, lab.limit(0))
    assert not any(r.toxic or r.severe for r in toxicity.score(docs, none).collect())


def solve(a, b):
    """Gaussian elimination."""
    n = len(b)
    m = [[*row_, y] for row_, y in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    out = [0.0] * n
    for i in range(n - 1, -1, -1):
        out[i] = (m[i][n] - sum(m[i][k] * out[k] for k in range(i + 1, n))) / m[i][i]
    return out


def brute_chain(docs, marks, texts):
    """(p_toxic, toxic, p_severe, severe) of each text by the method's definition on plain lists: docs id to text, marks id to label."""
    words = lambda t: {w.strip(",.;:!?\"'()[]{}|*#$%&<>-_/") for w in (t or "").lower().split()} - {""}
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    sigmoid = lambda x: 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))

    def fit(rows):  # rows (words, earlier log-odds, label)
        n1, n0 = max(sum(y for *_, y in rows), 1), max(sum(not y for *_, y in rows), 1)
        a, b = collections.Counter(), collections.Counter()
        for w, _, y in rows:
            (a if y else b).update(w)
        z = {}
        for w in a.keys() | b.keys():
            s = (a[w] + b[w]) / (n1 + n0)
            if a[w] + b[w] >= 3:
                z[w] = (a[w] / n1 - b[w] / n0) / math.sqrt(max(s * (1 - s), 1e-12) * (1 / n1 + 1 / n0))
        strong = [w for w in z if abs(z[w]) >= 5.0]
        x = [[*(float(w in have) for w in strong), *e, 1.0] for have, e, _ in rows]
        k = len(x[0])
        v, ridge = [0.0] * k, [0.1] * (k - 1) + [1e-6]
        for _ in range(25):
            p = [sigmoid(sum(c * d for c, d in zip(r, v, strict=True))) for r in x]
            h = [[sum(r[i] * r[j] * q * (1 - q) for r, q in zip(x, p, strict=True)) + (ridge[i] if i == j else 0) for j in range(k)] for i in range(k)]
            g = [sum(r[i] * (y - q) for r, q, (*_, y) in zip(x, p, rows, strict=True)) - ridge[i] * v[i] for i in range(k)]
            step = solve(h, g)
            v = [c + d for c, d in zip(v, step, strict=True)]
            if max(map(abs, step)) < 1e-6:
                break
        predict = lambda have, e: sigmoid(sum(c for w, c in zip(strong, v, strict=False) if w in have) + sum(c * d for c, d in zip(e, v[len(strong) : -1], strict=True)) + v[-1])
        return predict, {w for w in strong if z[w] > 0}

    cue = [i for i in marks if zlib.crc32(f"cue:{i}".encode()) % 4 == 0]
    cues = fit([(words(docs[i]), [], marks[i]) for i in cue])[1]
    ids = sorted(set(marks) - set(cue))
    have, earlier, found = {i: words(docs[i]) for i in ids}, {i: [] for i in ids}, [([], w) for w in map(words, texts)]
    results = [[] for _ in texts]
    for k in range(2):
        y = {i: bool(marks[i]) and (k == 0 or len(have[i] & cues) >= 3) for i in ids}
        out = {}
        for f in range(5):
            inside = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == f]
            model = fit([(have[i], earlier[i], y[i]) for i in ids if i not in inside])[0]
            out |= {i: model(have[i], earlier[i]) for i in inside}
        ranked, hits, best = sorted(ids, key=lambda i: -out[i]), 0, (-1.0, 0)
        for n, i in enumerate(ranked):
            hits += y[i]
            f1 = 2 * hits / (n + 1 + sum(y.values()))
            best = max(best, (f1, -n))
        at = -best[1]
        cutoff = (out[ranked[at]] + (out[ranked[at + 1]] if at + 1 < len(ranked) else 0.0)) / 2
        model = fit([(have[i], earlier[i], y[i]) for i in ids])[0]
        for r, (e, w) in zip(results, found, strict=True):
            p = model(w, e)
            r += [p, p >= cutoff]
            e.append(logit(p))
        for i in ids:
            earlier[i] = [*earlier[i], logit(out[i])]
    return results


def test_toxicity_against_brute_force(spark):
    bad, docs, marks = ["vile", "rotten", "nasty", "filthy", "foul"], {}, {}
    for i in range(700):
        w = prose(30).split()
        if i % 5 == 0:
            for k in range(1 + i % 4 + (i % 3 == 0) * 2):
                w[random.randrange(30)] = random.choice(bad) + random.choice(["", "!", "."])
        docs[i] = " ".join(w)
        if i < 560:
            marks[i] = int(i % 5 == 0) if i % 37 else 1  # some labels are wrong
    df = spark.createDataFrame([row(i, t) for i, t in docs.items()], SCHEMA)
    models = toxicity.train(df, spark.createDataFrame([(i, 1, y) for i, y in marks.items()], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, models).collect()}
    want = brute_chain(docs, marks, list(docs.values()))
    assert any(w[3] for w in want) and any(w[1] and not w[3] for w in want)
    for i, (p, toxic, q, severe) in zip(docs, want, strict=True):
        r = got[i]
        assert abs(r.p_toxic - p) < 1e-9 and abs(r.p_severe - q) < 1e-9 and (r.toxic, r.severe) == (toxic, severe)


def test_lm_scores(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm_score, "RANGE_BYTES", 50_000)
    rows = ODD + [row(200 + i, prose(50)) for i in range(60)]
    tok = lambda t: (t or "").encode().lower().split() + [b" end"]
    c = collections.Counter(x for r in rows if not lm_score.is_held_out(r[0]) for x in tok(r[1]))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], len(tok(r[1])), sum(c[x] > 0 for x in tok(r[1])), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(r[1])), 6)) for r in rows)
    got = lm_score.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2) for r in got)
    assert lm_score.score(docs.limit(0)).count() == 0


def brute_scores(rows):
    """doc_id to score, by the method's definition on plain dicts; weights from tokens whose own occurrence is deleted."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    tok = lambda t: (t or "").encode().lower().split() + [b" end"]
    pairs = lambda t: list(zip([b" end", *tok(t)], tok(t)))  # noqa: B905, E731
    c, two = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        if fold(i) != 2:
            c.update(tok(t))
            two.update(pairs(t))
    n, kinds = sum(c.values()), len(c)
    bucket = lambda h: min(int(math.log2(h + 1)), 23)
    binned = lambda p: 2.0 ** (-round(-math.log2(p) * 8) / 8) if p > 0 else 0.0
    seen = collections.defaultdict(list)
    for i, t, *_ in rows:
        if fold(i) == 3:
            for a, b in pairs(t):
                h = c[a] - 1
                seen[bucket(h)].append((binned((two[a, b] - 1) / max(h, 1)), binned((c[b] - 1) / (n - 1)), 1 / (kinds + 1)))

    def learn(data, w):
        for _ in range(60):
            shares = [0.0] * 3
            for p in data:
                s = sum(x * y for x, y in zip(w, p, strict=True))
                for k in range(3):
                    shares[k] += w[k] * p[k] / s
            w = [max(x / len(data), 1e-9) for x in shares]
            w = [x / sum(w) for x in w]
        return w

    pooled = learn([p for d in seen.values() for p in d], [0.4, 0.5, 0.1])
    weights = {b: learn(d, pooled) for b, d in seen.items()}
    total = collections.Counter()
    for i, t, *_ in rows:
        s = 0.0
        for a, b in pairs(t):
            w = weights.get(bucket(c[a]), pooled)
            s += math.log10(w[0] * two[a, b] / max(c[a], 1) + w[1] * c[b] / max(n, 1) + w[2] / (kinds + 1))
        total[i, round(s, 5)] += 1
    return total


@pytest.mark.parametrize("fanout", [256, 3])
def test_lm_scores_by_brute_force(spark, monkeypatch, fanout):
    """All of the method on one level of ranges and on three of them."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(lm_score, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(lm_score, "FANOUT", fanout)
    rows = [row(i, prose(5 + i % 40)) for i in range(150)] + [row(7, None), row(None, "a b A"), row(None, "")]
    got = lm_score.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, round(r.score, 5)) for r in got) == brute_scores(rows)


def test_lm_weights_sum_to_a_distribution():
    w = lm_score.mixture_weights([(3, 16, 40, 100), (3, 9999, 40, 50), (0, 9999, 9999, 10)], 1000)
    assert w.shape == (lm_score.BUCKETS, 3) and abs(w.sum(axis=1) - 1).max() < 1e-9 and w[0, 2] > 0.9


BASE_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_pii(spark, odd):
    texts = [
        "a@b.com_x@d.e mail é4111 1111 1111 1111, 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "+1 (017) 555-7713. tel +49-30-123456789 +1 2", None, "", "4111-1111-1111-1112 5500000000000004 1 2 3 4 5 6 7 8 9 0 1 2 3", "x" * 50_000 + "@",
        "1 " * 9000, "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765431", "token = 9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "日本 a.b@c.d.e日", " ".join(f"u{i}@h.org" for i in range(700)), "....@a..b c@d.. e@f.g.",
    ]
    rows = [row(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        for kind, (pattern, ok) in BASE_KINDS.items():
            want = [m.span() for m in re.finditer(pattern, t or "", re.ASCII) if ok(m.group())]
            assert [(s["start"], s["end"]) for s in got[i][kind]] == want, (i, kind)
    assert [(s["start"], s["end"]) for s in got[7]["iban"]] == [(0, 27)] and len(got[8]["secret"]) == 1 and not got[9]["secret"]
    assert got[1]["phone"][1]["score"] > 0.9 and pii.find_spans(odd).count() == len(ODD)


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["BE68539007547034.", "BE68539007547034 EUR 100", "AT611904300234573201 BANK", "ES9121000418450200051332 5", "pay GB82 WEST 1234 5698 7654 32 NOW", "BE68539007547035 EUR", "XX68539007547034", "NO9386011117947X"]
    found = {r.doc_id: [(x.start, x.end) for x in r.iban] for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: [(0, 16)], 1: [(0, 16)], 2: [(0, 20)], 3: [(0, 24)], 4: [(4, 31)], 5: [], 6: [], 7: []}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/17?x", "https://x.org/", "http://org", "http://com/fr/a#b", "http://a.com/de/", "http://badexample.org/es/", "http://notcom/fr/", "x://y://z.com/fr/", "http://com/FR/", "http://a.b.example.org/en/2", "http://host.com?/fr/"] * 2
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = ascii_lower(host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best[1:]), u
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("pmod(xxhash64(key), 20) = 0")
    c = url_filter.build_cascade(listed, universe)
    assert len(c.levels) > 1
    wrong = universe.withColumn("want", F.pmod(F.xxhash64("key"), F.lit(20)) == 0).where(c.contains(F.col("key")) != F.col("want"))
    assert wrong.count() == 0


def test_mixing(spark, docs, odd):
    rows = [row(i, prose(20 + i % 300), ["en", "de"][i % 2], f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"source": {"s0": 0.5, "s1": 0.25, "s2": 0.25}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"note": 0.5, "article": 0.5}}
    got = mixing.mix(df, targets).collect()
    expected = collections.Counter()
    for r in got:
        for d in ("source", "lang", "topic"):
            expected[d, r[f"__mix_{d}"]] += r["__mix_tokens"] * r["__mix_p"]
    whole = sum(v for (d, _), v in expected.items() if d == "lang")
    for d, shares in targets.items():
        for value, share in shares.items():
            assert expected[d, value] / whole == pytest.approx(share, abs=1e-6)
    assert all(0 <= r["__mix_p"] <= 1 for r in got)
    assert sorted(r.doc_id for r in mixing.mix(df.repartition(7), targets).where("__mix_kept").collect()) == sorted(r.doc_id for r in got if r["__mix_kept"])
    assert mixing.sample(odd).columns == odd.columns and len(mixing.mix(odd).collect()) == len(ODD) and mixing.sample(docs.limit(0)).count() == 0


def test_raking_as_a_table(spark, monkeypatch):
    cells = [("a", "x", "t", 10), ("a", "y", "t", 20), ("b", "x", "u", 30), ("b", "y", "t", 40)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 0.7, "u": 0.3}}
    few = dict(zip([c[:3] for c in cells], mixing.rake(cells, targets, 8), strict=True))
    got = mixing._rake_table(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets, 8).collect()
    assert {(r.source, r.lang, r.topic): r.w for r in got} == pytest.approx(few)


def test_mixing_beyond_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([row(i, BASE, ["en", None][i // 20], f"s{i % 20 % 7}") for i in range(40)], SCHEMA)
    few = {r.doc_id: (r["__mix_weight"], r["__mix_p"]) for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 5)
    many = {r.doc_id: (r["__mix_weight"], r["__mix_p"]) for r in mixing.mix(df).collect()}
    assert set(many) == set(few) and all(many[i] == pytest.approx(few[i], rel=1e-8) for i in few)


def test_raking_is_the_same_at_both_sizes(spark, monkeypatch):
    """Targets of values that do not occur, and values without a target, on the driver and as a table."""
    rows = [row(i, prose(30 + 7 * (i % 13)), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"source": {"s0": 0.5, "s1": 0.2, "s2": 0.1, "gone": 0.2}, "lang": {"en": 0.4, "fr": 0.3, "xx": 0.3}, "topic": {"note": 1.0}}
    got = []
    for cells in (mixing.MAX_CELLS, 1):
        monkeypatch.setattr(mixing, "MAX_CELLS", cells)
        got.append({r.doc_id: (round(r["__mix_weight"], 8), round(r["__mix_p"], 8), r["__mix_kept"]) for r in mixing.mix(df, targets).collect()})
    assert got[0] == got[1] and all(w == 0 for i, (w, _, _) in got[0].items() if i % 4 == 3)


def test_components_of_a_chain(spark):
    """Rising ids in a chain settle in a number of rounds that grows with the logarithm of its length."""
    written = []
    plain = near_dedup.materialize
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_dedup, "materialize", lambda df, label: written.append(label) or plain(df, label))
        got = near_dedup.components(spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(5000, 5001)], "a long, b long")).collect()
    assert len(got) == 1003 and all(r.label == (0 if r.node <= 1000 else 5000) for r in got)
    assert written.count("step") <= 20


def test_raking_as_a_table_to_the_end(spark):
    cells = [("a", "x", "t", 9000), ("a", "y", "t", 100), ("b", "x", "t", 100), ("b", "y", "t", 9000), ("b", "z", "t", 5)]
    targets = {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.4, "y": 0.5, "gone": 0.1}, "topic": {"t": 1.0}}
    few = dict(zip([c[:3] for c in cells], mixing.rake(cells, targets), strict=True))
    assert dict(zip([c[:3] for c in cells], mixing.rake(cells, targets, 30), strict=True)) != pytest.approx(few, rel=1e-8)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = mixing._rake_table(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long").coalesce(1), targets).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.source, r.lang, r.topic): r.w for r in got} == pytest.approx(few, rel=1e-8)


def test_urls_against_a_long_list(spark, monkeypatch):
    """200,000 rules in several parts and passes, given as a table, against a set."""
    monkeypatch.setattr(url_filter, "PART_KEYS", 30_000)
    listed = {(f"h{i}.net", "/a" if i % 3 else "/"): "block" if i % 2 else "allow" for i in range(200_000)}
    rules = spark.createDataFrame([(h, p, v) for (h, p), v in listed.items()], "host string, path string, verdict string")
    urls = [(i, f"https://{'www.' if i % 4 else ''}h{i * 37}.net/{'abc'[i % 3]}x?q") for i in range(8000)] + [(9000, None), (9001, "no url")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules, otherwise="none").collect()}
    want = {i: (None, "none") for i, _ in urls}
    for i in range(8000):
        host, path = f"h{i * 37}.net", f"/{'abc'[i % 3]}x"
        for p in ("/a", "/"):
            if (host, p) in listed and path.startswith(p) and want[i][0] is None:
                want[i] = (host + p, listed[host, p])
    assert got == want and len({v for _, v in got.values()}) == 3
