import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("geostrata.llm")
from geostrata.llm import latex, leaks, mixing, sentences  # noqa: E402

DOC = "doc_id long, text string, source string, item_id long"


WORD = re.compile(r"[^\W_]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 7) for i, t in rows], DOC)


def test_markup_is_read_away():
    words = WORD.findall(latex.plain(r"lanbo\'{\i}a gr\"o{\ss}e \c{c}a \~nu \emph{Word}s \cite[p. 3]{key1} \% x"))
    assert words == ["lanboía", "grösse", "ça", "ñu", "words", "x"] and latex.plain("größe") == latex.plain("GRÖSSE")
    assert latex.plain("\\newcommand{\\foo}{Bar} \\foo{} x").split()[-2:] == ["bar", "x"]
    assert latex.plain("") == ""


def brute(texts, items, n=12):
    own = {}
    for i, p in items:
        w = WORD.findall(latex.plain(p or ""))
        for k in range(len(w) - n + 1):
            own.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in texts:
        w = WORD.findall(latex.plain(t or ""))
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in own.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(12)] + [(90, None), (91, "too short"), (92, "")]
    texts = []
    for d in range(40):
        w = [r.choice(vocab) for _ in range(60)]
        if d % 2:
            p = items[d % 12][1].split()
            a, n = r.randrange(10), r.choice([11, 12, 20])
            w[20:20] = [f"\\emph{{{x.upper()}}}" if r.random() < 0.3 else x for x in p[a : a + n]]
        texts.append((d, "% ".join(" ".join(w[i : i + 9]) + "\n" for i in range(0, len(w), 9))))
    texts += [(50, None), (51, ""), (None, texts[1][1]), (1, texts[1][1])]
    it = spark.createDataFrame(items, "item_id long, passage string")
    want = brute(texts, items)
    for block in (20_000, 5):
        got = [(x.doc_id, x.item_id) for x in leaks.leaks(docs(spark, texts), it, block).filter("longest_run >= 12").collect()]
        assert set(got) == want and len(got) == len(set(got))
    assert leaks.leaks(docs(spark, texts), it.limit(0)).count() == 0 and leaks.leaks(docs(spark, []), it).count() == 0


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 3000)
    monkeypatch.setattr(leaks, "OVERLAP", 500)
    passage = " ".join(f"word{i}" for i in range(20))
    text = "filler text " * 230 + passage + " more text" * 900
    it = spark.createDataFrame([(1, passage)], "item_id long, passage string")
    assert [(r.longest_run, round(r.similarity, 6)) for r in leaks.leaks(docs(spark, [(5, text)]), it).collect()] == [(20, 1.0)]


def test_long_texts_give_what_they_give_in_one_piece(spark, monkeypatch):
    r = random.Random(5)
    own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in (18, 400)]
    items = [(1, own[0].replace(own[0].split()[9], "Macro")), (2, own[1])]
    macro = own[0].replace(own[0].split()[9], "\\mm{}")  # no run of 12 words without it
    filler = lambda: " ".join(f"f{r.randrange(10**6)}" for _ in range(400))
    text = "\\newcommand{\\mm}{Macro} " + " ".join([filler(), own[1], filler(), macro, filler(), "x" * 9000, macro, own[1]])
    d, it = docs(spark, [(5, text), (6, None)]), spark.createDataFrame(items, "item_id long, passage string")
    find = lambda: sorted(map(tuple, leaks.leaks(d, it).collect()))
    whole = find()
    assert [(x[1], x[2]) for x in whole] == [(1, 18), (2, 400)]
    monkeypatch.setattr(leaks, "CHUNK", 3000)
    monkeypatch.setattr(leaks, "OVERLAP", 500)
    assert find() == whole


def test_all_passages_of_an_item_are_searched(spark):
    p = {k: " ".join(f"{k}{i}" for i in range(15)) for k in "abcd"}
    it = spark.createDataFrame([(1, p["a"]), (1, p["b"]), (1, p["b"]), (None, p["c"]), (None, p["d"]), (2, None), (None, None)], "item_id long, passage string")
    d = docs(spark, [(i, p[k]) for i, k in enumerate("abcd")])
    for block in (20_000, 1, 2):
        got = [(r.doc_id, r.item_id, r.longest_run) for r in leaks.leaks(d, it, block).collect()]
        assert sorted(got, key=str) == [(0, 1, 15), (1, 1, 15), (2, None, 15), (3, None, 15)]


def test_weights_are_counted_over_all_items(spark):
    r = random.Random(8)
    common = " ".join(f"c{i}" for i in range(15))
    items = [(i, common + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(15))) for i in range(9)]
    it = spark.createDataFrame(items, "item_id long, passage string")
    d = docs(spark, [(0, common), (1, items[3][1])])
    find = lambda *b: sorted((x.doc_id, x.item_id, x.longest_run, round(x.similarity, 9)) for x in leaks.leaks(d, it, *b).collect())
    assert find() == find(2) == find(20_000, 100) and {x[1] for x in find() if x[3] == 1.0} == {3}


def test_altered_passages_are_found(spark):
    r = random.Random(11)
    new = lambda k: " ".join(f"{k}{r.randrange(3000)}" for _ in range(r.randrange(20, 90)))
    items = [(i, new("w")) for i in range(60)] + [(900, None), (901, "too short"), (902, "")]
    texts, want = [], set()
    for d in range(240):
        w = items[d % 60][1].split()
        for k in r.sample(range(len(w)), max(1, len(w) // r.choice([15, 25, 40]))):
            w[k] = f"new{r.randrange(10**6)}"
        five = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
        own = five(items[d % 60][1].split())
        if len(own & five(w)) >= 0.8 * len(own):  # shingles of these items are all of one weight
            want.add((d, d % 60))
        texts.append((d, f"{new('x')} {' '.join(w)} {new('y')}"))
    texts += [(500, None), (501, ""), (502, new("x"))]
    it, dd = spark.createDataFrame(items, "item_id long, passage string"), docs(spark, texts)
    for block in (20_000, 25):
        got = {(x.doc_id, x.item_id) for x in leaks.altered(dd, it, item_block=block).collect()}
        assert got <= want and len(got) >= 0.9 * len(want) > 50
    assert leaks.altered(dd, it.limit(0)).count() == 0 and leaks.altered(docs(spark, []), it).count() == 0


def test_wide_blocks_guarantee_their_radius():
    import numpy as np

    rng = np.random.default_rng(2)
    index = leaks.WideIndex([(1, " ".join(f"w{i}" for i in range(20)), {})], 1, str, 20)
    for _ in range(100):
        flip = sum(1 << int(b) for b in rng.choice(64, leaks.WIDE_RADIUS, replace=False))
        rows, hits = index.candidates(np.array([int(index.prints[0]) ^ flip], np.uint64))
        assert rows.tolist() == [0] and hits.tolist() == [0]
    words = leaks.word_hashes(" ".join(f"w{i % 97}" for i in range(700)))[0]
    for n in (12, 60, 300):
        assert (leaks.fingerprints(words, n) == leaks.fingerprints(words, n, np.arange(len(words) - n + 1))).all()


def test_fingerprints_within_the_radius_share_a_block():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for x in a:
        bits = rng.choice(64, leaks.RADIUS, replace=False)
        y = np.uint64(int(x) ^ int(sum(1 << int(b) for b in bits)))
        low, shared = 0, False
        for n in leaks.BLOCKS:
            mask = np.uint64(((1 << n) - 1) << low)
            shared |= bool((x & mask) == (y & mask))
            low += n
        assert shared


def test_word_hashes_are_of_the_words():
    a, _ = leaks.word_hashes("foo, bar foo_baz Ünï 12.5")
    b, _ = leaks.word_hashes("foo bar foo baz Ünï 12 5")
    assert (a == b).all() and a[0] == a[2] and len(set(a.tolist())) == 6


MIX = "mix_id int, source_name string, total_factor double, target_share double, max_repeat int"


def test_mixing_reaches_the_shares(spark):
    r = random.Random(1)
    rows = [(i, " ".join("word" for _ in range(r.randrange(5, 40))), r.choice(["Big", "big ", "BIG", "small-src"]) if i % 10 else "small_src") for i in range(400)] + [(900, None, "Big"), (901, "", None), (None, "some words here", "big")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([(1, "big", 0.5, 0.6, 1), (1, "small_src", 0.5, 0.4, 3), (2, "small src", 2.0, 0.9, 2), (2, "none", 1.0, 0.1, 5), (3, "big", 3.0, 0.5, 4)], MIX)
    sized = mixing.sizes(d)
    rep = {(x.mix_id, x.source_name): x for x in mixing.report(sized, t).collect()}
    for k, x in rep.items():
        most = min(x.target_tokens, x.max_repeat * x.source_tokens)
        assert abs(x.selected_tokens - most) <= 40 and x.most_copies <= x.max_repeat, k
    assert {k for k, x in rep.items() if x.short} == {(2, "small src"), (2, "none")}
    picks = mixing.select(sized, t)
    counts = {x.c for x in picks.filter("mix_id = 3").selectExpr("copies as c").distinct().collect()}
    e = rep[3, "big"].epochs
    one = mixing.select(mixing.sizes(d.withColumn("w", F.when(F.col("doc_id") % 2 == 0, 50.0)), weight=F.col("w")), t.filter("mix_id = 1 and source_name = 'big'")).collect()
    assert sum(x.doc_id is not None and x.doc_id % 2 == 0 for x in one) > 0.9 * len(one)
    assert counts <= {e, e + 1} and picks.count() == mixing.select(mixing.sizes(d), t).count()
    assert mixing.report(mixing.sizes(d.limit(0)), t).filter("selected_tokens > 0").count() == 0 and mixing.report(sized, t.limit(0)).count() == 0


def test_prefix_sums_in_bins(spark, monkeypatch):
    d = spark.createDataFrame([(i, "a b c d", "s") for i in range(200)], "doc_id long, text string, source string")
    sized = mixing.sizes(d)
    whole = sorted((x.before, x.doc_id) for x in mixing.prefix_sums(sized).collect())
    monkeypatch.setattr(mixing, "BIN_DOCS", 7)
    assert sorted((x.before, x.doc_id) for x in mixing.prefix_sums(sized).collect()) == whole and len({b for b, _ in whole}) == 200


TEXT = r"""\documentclass{article}
\title{No. One. Two.}
\begin{document}
\begin{abstract}
We follow D. B. Quorrin et al. In Fig. 3 it rose by 2.5 (see Eq.~(\ref{eq.1})). % not. here.
It \emph{ends.}
\end{abstract}

\section{Head. Line}

We obtain
\begin{equation}
 a = b.
\end{equation}
where $x = 3.$ Then it stops
\begin{itemize}
\item Not. This.
\end{itemize}
"""


def test_sentences_keep_out_of_markup():
    m = sentences.fit(sentences.counts(TEXT.replace("2.5", f"{k}.5") for k in range(3)))
    ends = m.sentence_ends(TEXT)
    said = {TEXT[max(0, e - 5) : e + 1] for e in ends}
    assert "ends.}" in said and any(s.endswith("stops") for s in said)
    for inner in ("title", "Head.", "Not.", "not.", "a = b"):
        at = TEXT.index(inner)
        assert not any(at <= e < at + len(inner) for e in ends)
    assert len(sentences.masked(TEXT)) <= len(TEXT) and m.sentence_ends("") == []


def test_sentence_model_learns_abbreviations(spark):
    r = random.Random(0)
    words = ["mesh", "layer", "signal", "cluster", "window"]
    make = lambda: f"The {r.choice(words)} follows Fig. {r.randrange(9)} of the {r.choice(words)}."
    texts = ["\n\n".join(" ".join(make() for _ in range(4)) for _ in range(6)) for _ in range(60)]
    d = docs(spark, [*enumerate(texts), (900, None), (901, ""), (902, "% only a comment")])
    got = {}
    for x in sentences.sentence_ends(d).collect():
        got.setdefault(x.doc_id, []).append(x.sent_end)
    assert set(got) == set(range(60))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == [m.end() - 1 for m in re.finditer(r"(?<!Fig)\.", t)]
    assert sentences.sentence_ends(d.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "count"), [("สวัสดี 12 ครับ ผมไป\nเธอมา", 3), ("他说：“好。”我走了。", 2), ("क्या है? वह है।", 2)])
def test_scripts(text, count):
    m = sentences.fit(sentences.counts([]))
    assert len(m.sentence_ends(text)) == count


def test_environments_without_an_end_stop_at_a_blank_line():
    m = sentences.Model({"b": 1.0})
    ends = lambda t: [t[max(0, e - 4) : e + 1] for e in m.sentence_ends(t)]
    assert ends("One two.\n\n\\begin{figure}\n\\includegraphics{x}\n\nThree four. Five six.\n") == [" two.", "four.", " six."]
    assert ends("\\begin{itemize}\n\\item A b.\n\\begin{itemize}\n\\item C d.\n\\end{itemize}\nE f.\n\\end{itemize}\n\nG hij.") == [" hij."]
    assert ends("\\begin{figure} a.\n\\section{B}\nThree four.\n\n\\begin{figure} c. \\end{figure}\n\nFive six.") == ["four.", " six."]
    assert ends("So\n\\[ a = b.\n\nThree four.\n\n$$ x. \n\nFive six.")[-2:] == ["four.", " six."]


def test_thai_gaps_are_classified():
    text = "ระบบนี้ทำงานได้ดี ผลลัพธ์อยู่ใน 25 ตัวอย่าง การทดลองใช้ LaTeX และ $x$ ซึ่งดีมาก\nเราสรุปผล"
    m = sentences.fit(sentences.counts([text] * 5))
    assert [text[e - 2 : e + 1] for e in m.sentence_ends(text)] == [text[text.index(" ผลลัพธ์") - 3 : text.index(" ผลลัพธ์")], text[text.index(" การทดลอง") - 3 : text.index(" การทดลอง")], text[text.index("\nเรา") - 3 : text.index("\nเรา")], text[-3:]]
