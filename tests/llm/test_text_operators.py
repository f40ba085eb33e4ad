"""Language, decontamination, quality and line operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import decontaminate as D
from skytally.llm import language as L
from skytally.llm import lines as N
from skytally.llm import quality as Q

WORDS = {"en": "the and of was with which there from that would been house river stone".split(),
         "de": "der und ist nicht durch werden größe schön straße zwischen haben über".split(),
         "fr": "les des être avec pour dans elle sont été après même où çà".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(n=240):
    rng = random.Random(1)
    return [(i, prose(rng, lang, 30 + i % 50), lang, f"s{i % 3}") for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(n))]


# ---------------------------------------------------------------- language


def test_languages_are_told_apart(make_docs, clashing):
    rows = corpus()
    odd = [(900, None, "en"), (901, "", "de"), (902, " 12 %% \n 3", "fr"), (903, "the was with" * 100000, None), (904, "Größe", None), (None, "the and of", None)]
    docs = clashing(make_docs(*rows, *odd, rows[0]))
    out = L.language_of(docs).collect()
    assert len(out) == len(rows) + len(odd) + 1
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    assert all(by[i][0][0] == lang for i, _, lang, _ in rows) and by[0][0] == by[0][1]
    assert [by[i][0][:2] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903][0][0] == "en" and by[904][0][0] == "de" and by[None][0][0] == "en"
    assert all(0 <= s <= 1 for v in by.values() for _, s, _ in v) and {h for v in by.values() for *_, h in v if h is not None} == {True, False}
    assert L.language_of(make_docs()).collect() == []
    assert [r.lang_pred for r in L.language_of(make_docs((1, "the"))).collect()] == ["und"]


def test_languages_equal_naive_sums(make_docs):
    """Bind, bundle and compare, trigram by trigram."""
    rows = corpus(60) + [(100, "ελληνικά και λόγια", "el", "s"), (101, "λόγια του κόσμου και της γης", "el", "s"), (102, "слова и мир на земле", "ru", "s"), (103, "мир и слова", "ru", "s"),
                         (104, "漢字 漢字 中文", "zh", "s"), (106, "中文 漢字", "zh", "s"), (107, chr(0x30001) + chr(0x31351), None, "s"), (None, "the of", None, None)]
    vectors, symbol = L._letters()

    def bundle(text):
        s = [0]
        for c in text:
            k = int(symbol[ord(c)])
            if k or s[-1]:
                s.append(k)
        s += [0] if s[-1] else []
        total = np.zeros(L.DIMENSIONS)
        for a, b, c in zip(s, s[1:], s[2:]):
            if a or b or c:
                total += np.roll(vectors[a].astype(float), 2) * np.roll(vectors[b].astype(float), 1) * vectors[c]
        return total

    docs = make_docs(*rows)
    names, protos = L.prototypes(docs)
    sums = {n: sum(np.rint(v / np.linalg.norm(v) * L._UNIT) for v in (bundle(t) for _, t, lang, _ in rows if lang == n)) for n in names}
    assert names == sorted({r[2] for r in rows if r[2]}) and all(np.abs(protos[i] - sums[n]).max() <= len(rows) for i, n in enumerate(names))
    got = {r.doc_id: r for r in L.identify(docs, names, protos).collect()}
    for i, t, *_ in rows:
        v = bundle(t)
        cos = [float(v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n])) for n in names]
        assert got[i].lang_pred == names[int(np.argmax(cos))] and got[i].cosine == pytest.approx(max(cos), abs=1e-5)
        assert got[i].score == pytest.approx(1 / sum(np.exp(L.SHARPNESS * (c - max(cos))) for c in cos), abs=1e-4)
    assert all(got[i].lang_pred == lang for i, lang in ((100, "el"), (102, "ru"), (104, "zh")))
    assert {r.held_out for r in L.language_of(docs).collect()} == {True, False}


def test_short_clean_texts_are_kept(make_docs):
    rows = corpus(240)
    names, protos = L.prototypes(make_docs(*rows))
    short = [(1000 + i, w) for i, w in enumerate(["Avec", "der Stein", "the river", "après", "und", "schön hier", "house of stone"])]
    junk = [(2000, "zqxj kvwq " * 60 + "xqzk jjkx"), (2001, "1 2 3"), (2002, None)]
    kept = {r.doc_id for r in L.known_language(make_docs(*rows[:50], *short, *junk), names, protos).collect()}
    assert kept >= {r[0] for r in rows[:50] + short} and not kept & {2001, 2002}


def test_labels_of_held_out_documents_teach_nothing(make_docs, spark):
    rows = corpus(120)
    docs = make_docs(*rows)
    wrong = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert L.language_of(wrong).orderBy("doc_id").collect() == L.language_of(docs).orderBy("doc_id").collect()


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = prose(random.Random(3), "de", 400)
    whole = L._trigrams(text)
    monkeypatch.setattr(L, "_PIECE", 7)
    assert np.array_equal(L._trigrams(text), whole)


# ---------------------------------------------------------------- decontamination


def edited(rng, text, k):
    t = list(text)
    for _ in range(k):
        t[rng.randrange(len(t))] = rng.choice("xyz")
    return "".join(t)


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_passages_are_found(make_docs, spark, clashing):
    rng = random.Random(7)
    items = [(i, letters(rng, 40)) for i in range(12)] + [(20, None), (21, ""), (22, "a b c"), (None, letters(rng, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [(i, letters(rng, 300)) for i in range(30)]
    leaky = [(100 + i, letters(rng, 60) + " " + items[i][1].upper().replace(" ", "\n") + "! " + letters(rng, 50)) for i in range(6)]
    near = [(200 + i, letters(rng, 20) + " " + edited(rng, items[i][1], 8) + " " + letters(rng, 20)) for i in range(6)]
    part = [(300 + i, letters(rng, 20) + " " + items[i][1][30:150] + " " + letters(rng, 20)) for i in range(6)]
    long = [(400, letters(rng, 400000) + " " + items[3][1] + " " + letters(rng, 10))]
    odd = [(500, None), (501, ""), (502, "a b c"), (None, items[2][1]), (600, items[-1][1])]
    docs = clashing(make_docs(*clean, *leaky, *near, *part, *long, *odd, leaky[0]))
    got = [(r.doc_id, r.item_id) for r in D.leaks(docs, clashing(bench)).collect()]
    assert sorted(got, key=str) == sorted([(100 + i, i) for i in range(6)] + [(100, 0)] + [(200 + i, i) for i in range(6)] + [(300 + i, i) for i in range(6)]
                                          + [(400, 3), (None, 2), (600, None)], key=str)
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in clean] + [500, 501, 502]
    assert D.leaks(make_docs(), bench).collect() == [] and D.leaks(docs, bench.limit(0)).collect() == []
    assert D.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_passages_are_found_wherever_they_begin():
    """Verbatim passages of 64 normalised characters from every place of an item, whole words or not."""
    rng = random.Random(12)
    items = [letters(rng, 45)[:n].strip() for n in (64, 65, 71, 100, 163, 226)]
    ix = D.index(list(enumerate(items)))
    for i, item in enumerate(items):
        spans = [item[at:at + D.SEGMENT] for at in range(len(item) - D.SEGMENT + 1)]
        texts = [letters(rng, 15) + " " + s.strip() + " " + letters(rng, 15) for s in spans if s == s.strip()]
        texts += [letters(rng, 15) + s + letters(rng, 15) for s in spans]
        assert {t for t, k in zip(*D.find(ix, texts)[:2]) if k == i} == set(range(len(texts)))
    assert not len(D.find(ix, [letters(rng, 400)])[0])


def test_repetitive_texts_stay_small(monkeypatch):
    """One q-gram that fills item and document, in slices and at once."""
    rng = random.Random(13)
    ix = D.index([(1, "a" * 1000), (2, "ab " * 300), (3, letters(rng, 40))])
    assert len(ix.codes) < 40 + 80
    texts = ["a" * 30_000, "x " + "ab " * 4000, letters(rng, 50), "b" * 500]
    whole = D.find(ix, texts)
    assert set(zip(whole[0].tolist(), [ix.ids[i] for i in whole[1]])) == {(0, 1), (1, 2)}
    monkeypatch.setattr(D, "POSTINGS", 1000)
    assert all((a == b).all() for a, b in zip(whole, D.find(ix, texts)))


def test_bands_lose_no_alignment_within_the_budget():
    """Every region within the edit budget, found by full dynamic programming, is reported."""
    rng = random.Random(9)
    item = letters(rng, 12)[:64]
    ix = D.index([(1, item)])
    for trial in range(200):
        text = letters(rng, 10) + " " + edited(rng, item, rng.randrange(9)) + " " + letters(rng, 10)
        codes = D.normalised([text])[0][:-1]
        best = np.zeros(len(codes) + 1, int)
        for c in ix.codes[0][:ix.lengths[0]]:
            row = np.empty_like(best)
            row[0] = best[0] + 1
            for j in range(1, len(best)):
                row[j] = min(best[j - 1] + (codes[j - 1] != c), best[j] + 1, row[j - 1] + 1)
            best = row
        found = D.find(ix, [text])
        assert (best.min() <= ix.budget[0]) == (len(found[0]) == 1)
        if len(found[0]):
            assert found[3][0] == best.min()


# ---------------------------------------------------------------- quality


def test_quality_learns_noise(make_docs, spark, clashing):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        text = prose(rng, "en", 60 + i % 80)
        rows.append((i, text if good else " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in text.split())))
        labels.append((i, int(good)))
    odd = [(900, None), (901, ""), (902, "the " * 100000), (None, "the and of"), rows[0]]
    labels += [(5000, 1), (901, None), (None, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = Q.quality_of(clashing(make_docs(*rows, *odd)), clashing(lab)).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    by = {r.doc_id: r.score for r in out}
    assert by[900] == by[901]
    assert [r.score for r in Q.quality_of(make_docs((1, "a")), lab.limit(0)).collect()] == [0.5]
    assert Q.quality_of(make_docs(), lab).collect() == []


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 896, 897, 5000):
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        c = Q.chunks(text)
        joined = b"".join(row[:Q.ADVANCE].tobytes() for row in c[:-1]) + c[-1].tobytes()
        assert joined.rstrip(b"\0") == text


def test_scores_equal_naive_convolution():
    rng = np.random.default_rng(4)
    net = Q._start(rng)
    for p in net.parts():
        p[...] += 0.1 * rng.standard_normal(p.shape).astype(np.float32)
    x = rng.integers(0, 255, (3, Q.CHUNK), dtype=np.uint8)
    x[2, 100:] = 0
    for row, got in zip(x, Q.chunk_logits(net, x)):
        seen = net.embed[row]
        pooled = np.full(Q.FILTERS, -np.inf)
        for at in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE):
            pooled = np.maximum(pooled, seen[at:at + Q.WIDTH].reshape(-1) @ net.kernel.reshape(-1, Q.FILTERS) + net.bias)
        hidden = np.maximum(np.maximum(pooled, 0) @ net.w1 + net.b1, 0)
        assert got == pytest.approx(float((hidden @ net.w2 + net.b2).ravel()[0]), rel=1e-3, abs=1e-3)


def test_repeated_ids_teach_once(make_docs, spark):
    rows = [(i, ("good text here " if i % 2 else "%%% $$ ### ") * 20) for i in range(60)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, often = Q.train(make_docs(*rows), lab), Q.train(make_docs(*rows, *[rows[1]] * 500), lab)
    assert all((a == b).all() for a, b in zip(once.parts(), often.parts())) and (once.combine == often.combine).all()


def test_gradients_are_right():
    rng = np.random.default_rng(3)
    net = Q._start(rng)
    for p in net.parts():
        p[...] += 0.05 * rng.standard_normal(p.shape)
    x, y = rng.integers(0, 255, (6, Q.CHUNK), dtype=np.uint8), np.array([0, 1, 0, 1, 1, 0], np.float32)

    def loss():
        z = Q.chunk_logits(net, x).astype(float)
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    for p, g in zip(net.parts(), Q._gradients(net, x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 2e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=1e-4)


# ---------------------------------------------------------------- lines


def brute_lines(rows):
    occ = [(i, k, l.lower().strip(" ")) for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0])) for k, l in enumerate(t.split("\n"))]
    names = list(dict.fromkeys(l for *_, l in occ if l))
    sets = [{l[i:i + 8] for i in range(max(1, len(l) - 7))} for l in names]
    lead = list(range(len(names)))

    def find(a):
        while lead[a] != a:
            a = lead[a]
        return a

    for a in range(len(names)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n >= 0.75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    at, first = {l: i for i, l in enumerate(names)}, {}
    for i, k, l in occ:
        if l:
            first.setdefault(find(at[l]), (i, k))
    return [(i, k, *(first[find(at[l])] if l else (None, None))) for i, k, l in occ]


def test_lines_equal_brute_force(make_docs, clashing):
    rng, rows = random.Random(5), []
    base = [letters(rng, rng.choice([1, 3, 12, 30, 60])) for _ in range(40)]
    for d in range(60):
        lines = [rng.choice([lambda b: b, str.upper, lambda b: " " + b, lambda b: edited(rng, b, 1), lambda b: b + " z"])(rng.choice(base)) for _ in range(rng.randrange(1, 6))]
        rows.append((d, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n \nx"), (903, "q" * 3000), (904, "q" * 3001), (906, "-" * 20 + "\n" + "-" * 100 + "\n" + "-" * 1000), (907, "ab" * 10 + "\n" + "ab" * 500), (None, base[0]), (905, "x")]
    out = N.fuzzy_lines(clashing(make_docs(*rows))).collect()
    want = brute_lines(rows)
    assert sorted(((r.doc_id, r.line_no, r.keeper_doc, r.keeper_line) for r in out), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.keeper_line is None or (r.doc_id, r.line_no) == (r.keeper_doc, r.keeper_line)) for r in out)
    assert N.fuzzy_lines(make_docs()).collect() == []


def test_near_copies_below_the_bound_write_no_row_for_each_pair(make_docs, monkeypatch):
    """Copies with four words of thirty changed are mostly too unlike each other, in a band of several tiles' blocks."""
    rng, written = random.Random(23), []
    words = [letters(rng, 6)[:6].replace(" ", "x") for _ in range(30)]
    head = "every copy begins with the same words as all of the others do so that they meet in one band "
    rows = []
    for d in range(600):
        mine = list(words)
        for k in rng.sample(range(30), 3 if d % 3 else 1):
            mine[k] = letters(rng, 6)[:6].replace(" ", "y")
        rows.append((d, head * (d % 2) + " ".join(mine)))

    def counted(df, name="stash"):
        written.append((name, (out := real(df, name)).count()))
        return out

    real = N.stash
    monkeypatch.setattr(N, "stash", counted)
    out = N.fuzzy_lines(make_docs(*rows)).collect()
    assert sorted((r.doc_id, r.line_no, r.keeper_doc, r.keeper_line) for r in out) == sorted(brute_lines(rows))
    bands = sum(len(b) for b in [r.bands for r in N._signed(_signed_input(make_docs(*rows))).collect()])
    assert max(n for _, n in written) <= bands


def test_bands_of_the_same_lines_are_compared_once(spark):
    """Near copies share many bands; a band meets in tiles only if no other one holds the same lines."""
    held = {7: (1, 2), 8: (1, 2), 3: (1, 2, 5), 4: (2, 5), -6: (5, 2), 9: (3, 5)}
    rows = spark.createDataFrame([(b, n) for b, names in held.items() for n in names], "band long, name long")
    assert sorted(map(tuple, N._once(rows).collect())) == sorted((b, n) for b in (7, 3, -6, 9) for n in held[b])


def test_documents_of_one_id_have_their_own_lines(make_docs):
    rows = [(0, "x" * 60), (0, "a line of another document"), (1, "a line of another document."), (2, "x" * 61)]
    out = N.fuzzy_lines(make_docs(*rows)).collect()
    assert sorted((r.doc_id, r.line_no, r.keeper_doc, r.keeper_line) for r in out) == sorted(brute_lines(rows))


def _signed_input(docs):
    return N.lines_of(docs).select("doc_id", "line_no", N.plain(F.col("line")).alias("text")).select("*", *N._keys(F.col("text")))


def test_tile_counts_equal_plain_sets():
    """Few lines of many tiles at once, and all lines of one tile, against plain sets."""
    rng = random.Random(29)
    tiles = []
    for k in range(60):
        base = letters(rng, 40)
        tiles.append([rng.choice([base, "ab" * rng.randrange(1, 40), edited(rng, base, rng.randrange(1, 3)), "a"]) for _ in range(rng.randrange(2, 9))])
    texts = [t for tile in tiles for t in tile]
    of = np.repeat(np.arange(len(tiles)), [len(t) for t in tiles])
    place = np.concatenate([np.arange(len(t)) for t in tiles])

    def close(a, b):
        x, y = shingles(a), shingles(b)
        return len(x & y) >= 0.75 * len(x | y)

    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if of[i] == of[j] and close(texts[i], texts[j])}
    assert set(zip(*(v.tolist() for v in N._few_links(texts, of, place, 0.75)))) == want and want
    first, second = np.arange(0, 40), np.arange(40, 90)
    want = {(i, j) for i in first.tolist() for j in second.tolist() if close(texts[i], texts[j])}
    assert set(zip(*(v.tolist() for v in N._tile_links(texts, first, second, 0.75)))) == want and want
    assert N._leaders(6, np.array([4, 5]), np.array([5, 2])).tolist() == [0, 1, 2, 3, 2, 2]


def test_kept_lines_make_texts(make_docs):
    docs = make_docs((1, "one two three four\nfive"), (2, "One two three four\nsix\n"), (3, None))
    got = {r.doc_id: r.text for r in N.without_repeats(docs, N.fuzzy_lines(docs)).collect()}
    assert got == {1: "one two three four\nfive", 2: "six\n", 3: None}


def shingles(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def test_bands_meet_at_every_length(spark):
    """Pairs at a similarity of 0.75 to 0.80 share a band, all of them where the sets are small."""
    rng = random.Random(11)
    pairs, seen = [("chapter 10", "chapter 100"), ("qwertyuiopa", "qwertyuiopas")], Counter()

    def add(a, b, kind):
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        if a != b and j >= 0.75 and (j <= 0.8 or len(a) < 20):
            pairs.append((a, b))
            seen[kind] += 1

    # one character more, at either end
    for n in range(10, 40):
        for _ in range(40):
            a = letters(rng, 20).replace(" ", rng.choice(["", " "]))[:n].strip()
            more = "".join(rng.choice("abcdefgh") for _ in range(max(1, (len(a) - 7) // 3)))
            add(a, rng.choice([a + more, more + a]), "grown")
    for n in (60, 100, 128, 129, 160, 240, 400, 800):
        while seen[n] < 150:
            a = letters(rng, n)[:n].strip()
            add(a, edited(rng, a, max(1, round(n * rng.uniform(0.012, 0.025)))), n)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    text = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lit(0).alias("line_no"), "text", *N._keys(F.col("text")))
    bands = {}
    for r in N._bands(text).select("name", "band").collect():
        bands.setdefault(r["name"], set()).add(r.band)
    name = {r.text: r.h1 for r in text.select("text", "h1").collect()}
    lost = [(a, b) for a, b in pairs if not bands[name[a]] & bands[name[b]]]
    assert seen["grown"] > 500 and not [p for p in lost if max(len(shingles(t)) for t in p) <= 32]
    assert len(lost) <= 2
