"""Sentences of articles in many languages and scripts.

Text is separated from markup first: positions are kept, everything that isn't running text becomes a placeholder of
its kind. Every mark that may end a sentence is a candidate, and so is every gap beside Thai script, which has no
marks. A maximum-entropy model decides from the tokens beside it, their case, length, figures and script, the mark and
what closes after it. It is trained on reliable boundaries: what stands before paragraph ends and after paragraph
starts is known to end and to start sentences, so a token that is frequent before marks inside paragraphs but never
ends one (an abbreviation), or is frequent after marks but never starts one, gives reliable examples of no boundary,
and tokens that do both give reliable boundaries. Gaps between Thai letters are reliable boundaries; gaps beside
figures, formulas, references and Latin words are reliable examples of none. The counts are made in tasks.

Nulls: a null or empty text has no sentences; a null id is kept. Each row is cut by itself, so repeated rows give
repeated ends unless the caller drops them. Texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the model is fitted on, at most about.
FIT_DOCS = 12_000
#: How often a token must have been met to be known; how often it had to be met at paragraph ends or starts before its absence there counts.
SEEN, MANY = 10, 5.0

# Placeholders, one for each character they stand for.
DISPLAY, FORMULA, SIGN, REFERENCE, OPEN, WORD, BREAK = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue00f"

_ARG = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
# Every branch starts with its own sign, so the scan only stops at those.
MARKUP = re.compile(
    rf"""
    %(?P<comment>[^\n]*\n?[ \t]*)
  | \\(?:
      (?P<off>iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z))
    | (?P<edge>(?:begin|end)\{{(?:abstract|document)\}}(?:\[[^\]]*\])?)
    | (?P<env>begin\{{(?P<name>[A-Za-z]+\*?)\}})
    | (?P<display>\[(?:.*?\\\]|(?:(?!\n[ \t\r]*\n).)*))
    | (?P<heading>(?:(?:sub)*section|(?:sub)?paragraph|chapter|part|title|author|date|thanks|documentclass|usepackage|input|include|bibliography(?:style)?|maketitle|tableofcontents|appendix|end|item|caption|centering|includegraphics|affiliation|keywords)\*?(?![A-Za-z])[ \t]*(?:\[[^\]]*\])?[ \t]*(?:{_ARG})?(?:\s*\\label\{{[^{{}}]*\}})?)
    | (?P<own>(?:(?:re)?newcommand|providecommand)\*?\s*\{{?\\[A-Za-z]+\}}?(?:\[[^\]]*\])*\s*{_ARG}|def\s*\\[A-Za-z]+(?:\#\d)*\s*{_ARG}|label\{{[^{{}}]*\}})
    | (?P<formula>\(.*?\\\))
    | (?P<reference>(?:cite[a-z]*|[A-Za-z]*ref)\*?(?![A-Za-z])(?:\[[^\]]*\])*\{{[^{{}}]*\}})
    | (?P<opening>[A-Za-z]+\*?\{{(?!\}}))
    | (?P<word>[A-Za-z]+\*?(?:\{{\}})?)
    | (?P<symbol>.)
    )
  | \$(?:(?P<dollars>\$(?:.*?\$\$|(?:(?!\n[ \t\r]*\n).)*))|(?P<inline>(?:\\.|[^$\\])*\$))
  | \{{(?P<brace>)
    """,
    re.X | re.S,
)
KIND = {"inline": "formula", "dollars": "display"}
FILLER = {"own": " ", "off": " ", "comment": " ", "edge": BREAK, "env": BREAK, "heading": BREAK, "reference": REFERENCE, "opening": OPEN, "word": WORD, "brace": OPEN}
MATH = re.compile(r"(?:equation|align|gather|multline|eqnarray|displaymath|flalign|alignat)\*?\Z")
#: Where an environment without an end stops at the latest.
OPEN_END = re.compile(r"\n[ \t\r]*\n|\\(?:sub)*section(?![A-Za-z])|\\end\{document\}")
BLANK_BEFORE, BLANK_AFTER = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*\Z"), re.compile(r"[ \t\r]*\n[ \t\r]*\n|\s*\Z")
PARAGRAPH = re.compile(rf"\n[ \t\r]*\n\s*|{BREAK}[\s{BREAK}]*")
CLOSER = r"""["'”’»)\]}」』）】〉》""" + SIGN + "]"
#: “ closes a German quotation, but opens one after the marks of scripts without blanks.
MARK = re.compile(rf"(?:[.!?]+(?:(?:{CLOSER}|“|\s»)+[.!?]*)*)(?![…。！？])|[.!?…。．！？।॥؟۔;;|]+(?:(?:{CLOSER}|\s»)+[.!?…。！？।؟]*)*")
THAI_SIDE = "Tl"
LETTER, THAI = re.compile(rf"[^\W_]|{FORMULA}"), re.compile("[฀-๿]")
WIDE = frozenset("。．！？")
OPENERS = "([{«“„‘`\"'「『（【¿¡‹" + OPEN
SUFFIX = "\"'”’“»)]}」』）】〉》" + SIGN + OPEN
GAP = re.compile(r"(?<=\S)\s+(?=\S)")
MARKS = frozenset(".!?…。．！？।॥؟۔")
SPACE = re.compile(r"\s+")


def _env_end(text: str, name: str, at: int, stop: int) -> int:
    """Where the environment ends whose \\begin ends at 'at': at its own \\end, others of the name inside it counted; without one before the next blank line or heading."""
    open_ = 1
    for m in re.compile(r"\\(begin|end)\{" + re.escape(name) + r"\}").finditer(text, at, stop):
        open_ += 1 if m[1] == "begin" else -1
        if not open_:
            return m.end()
    # one that is missing somewhere: the next \\end, unless another begins before it
    begin, end = text.find(f"\\begin{{{name}}}", at, stop), text.find(f"\\end{{{name}}}", at, stop)
    if end >= 0 and (begin < 0 or end < begin):
        return end + len(name) + 6
    m = OPEN_END.search(text, at, stop)
    return m.start() if m else stop


def masked(text: str) -> str:
    """The text with markup as placeholders; as long as the text."""
    start = text.find("\\begin{document}")
    out, last = [], 0
    if start >= 0:
        last = start + 16
        out.append(BREAK * last)
    stop = text.find("\\end{document}", last)
    stop = len(text) if stop < 0 else stop
    while m := MARKUP.search(text, last, stop):
        a, b = m.span()
        kind = KIND.get(m.lastgroup, m.lastgroup)
        if kind == "env":
            kind = "display" if MATH.match(m["name"]) else "env"
            b = _env_end(text, m["name"], b, stop)
        if a > last:
            out.append(text[last:a])
        n = b - a
        if kind == "formula":
            close = 1 if text[b - 1] == "$" else 2
            mark = text[b - close - 1]
            out.append(FORMULA * (n - close - 1) + mark + SIGN * close if mark in ".?!" and n > close + 1 else FORMULA * n)
        elif kind == "display":
            apart = BLANK_BEFORE.search(text, max(0, a - 40), a) and BLANK_AFTER.match(text, b)
            out.append((BREAK if apart else DISPLAY) * n)
        elif kind == "symbol":
            s = text[a + 1]
            out.append("  " if s in " \\,;:!\n" else OPEN * 2 if s in "\"'`^~=.-/" else WORD * 2)
        else:
            out.append(FILLER[kind] * n)
        last = b
    if last < stop:
        out.append(text[last:stop])
    return "".join(out)


def paragraphs(mask: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in PARAGRAPH.finditer(mask):
        if m.start() > last:
            yield last, m.start()
        last = m.end()
    if last < len(mask):
        yield last, len(mask)


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "L"
    if o in range(0x370, 0x400) or o in range(0x1F00, 0x2000):
        return "G"
    if o < 0x530:
        return "C"
    if o in range(0x600, 0x700):
        return "A"
    if o in range(0x900, 0x980):
        return "D"
    if o in range(0xE00, 0xE80):
        return "T"
    return "J" if 0x3000 <= o < 0xA000 or 0xFF00 <= o < 0xFFF0 else "O"


def _left(mask: str, lo: int, at: int) -> tuple[str, str]:
    """(token before the mark, its shape)."""
    end = at
    while end > lo and mask[end - 1].isspace():
        end -= 1
    piece = mask[max(lo, end - 24) : end]
    token = piece.rsplit(None, 1)[-1] if piece else ""
    token = token.rstrip(SUFFIX).lstrip(OPENERS)
    if not token:
        return "", "none"
    c = token[-1]
    if c in (FORMULA, DISPLAY):
        return "$", "formula"
    if c == REFERENCE:
        return "@", "reference"
    if c == WORD:
        return "\\", "macro"
    script = _script(c)
    if script == "J":
        return token[-2:], "J"
    if script == "T":
        return token[-2:], "T"
    if c.isdigit():
        head = token.lstrip("-+")
        if head.isdigit():
            return "0" * min(len(head), 4), f"int{min(len(head), 4)}"
        return "0.0", "number"
    if "." in token:
        return token.lower(), f"{script}dotted"
    n = len(token)
    case = "U" if token[0].isupper() else "l"
    return token.lower() if n < 14 else token[-6:].lower(), f"{script}{case}{1 if n == 1 else 2 if n == 2 else 3 if n <= 4 else 5}"


DIGITS = re.compile(r"\d+")


def _right(mask: str, at: int, hi: int) -> tuple[str, str, str]:
    """(token after the blank, token and the next one, class) at the start of what follows."""
    piece = mask[at : min(hi, at + 40)]
    bare = piece.lstrip(OPENERS)
    opened = "(" if len(bare) < len(piece) and piece[0] in "([（" else "q" if len(bare) < len(piece) and piece[0] != OPEN else ""
    bare = bare.lstrip()
    if not bare:
        return "", "", "end"
    c = bare[0]
    if c == FORMULA:
        return "$", "$", opened + "formula"
    if c == DISPLAY:
        return "$$", "$$", opened + "display"
    if c == REFERENCE:
        return "@", "@", opened + "reference"
    if c == WORD:
        return "\\", "\\", opened + "macro"
    if c.isdigit():
        return "0", "0", opened + "digit"
    script = _script(c)
    if script == "J":
        return bare[:1], bare[:2], opened + "J"
    words = SPACE.split(bare, 2)
    one = words[0].rstrip(".,;:!?" + SUFFIX)
    two = one + " " + (DIGITS.sub("0", words[1].lstrip(OPENERS).rstrip(".,;:!?" + SUFFIX)) if len(words) > 1 else "")
    if not c.isalpha():
        return one, one, opened + "sign"
    return one, two, opened + script + ("U" if c.isupper() else "l")


def _mark(run: str) -> tuple[str, str]:
    """(kind of mark, kind of what closes after it)."""
    kind = "…" if run.startswith("..") or "…" in run else run[0]
    tail = run.lstrip(".!?…。．！？।॥؟۔;\u037e|")
    quote = any(c in "\"'”’“»」』" for c in tail)
    return kind, ("q" if quote else "") + (")" if any(c in ")]）】" for c in tail) else "") + ("$" if SIGN in tail else "")


class Cut:
    """A paragraph's candidates: (end, key, right) and where it ends; key is what the model sees."""

    __slots__ = ("candidates", "last", "start")


def cuts(text: str) -> Iterator[Cut]:
    mask = masked(text)
    for lo, hi in paragraphs(mask):
        while hi > lo and mask[hi - 1] in " \t\r\n\u00a0~":
            hi -= 1
        while hi > lo and mask[lo].isspace():
            lo += 1
        body = mask[lo:hi]
        if not LETTER.search(body):
            continue
        p = Cut()
        p.last, p.start, p.candidates = hi - 1, _right(mask, lo, hi), []
        for m in MARK.finditer(mask, lo, hi):
            a, b = m.span()
            run = m.group()
            first = run[0]
            if first in ";|\u037e":
                before = mask[max(lo, a - 2) : a].rstrip()
                before = before.rstrip("}") or before
                if not before or _script(before[-1]) != ("D" if first == "|" else "G"):
                    continue
            after = b
            while after < hi and mask[after].isspace():
                after += 1
            if after == b and b < hi and not (WIDE & set(run)) and not (mask[b] in "「『“" or ("…" in run and _script(mask[b]) == "J") or (_script(mask[b]) == "J" and first in "!?")):
                continue
            if b >= hi:
                p.candidates.append((b - 1, (*_left(mask, lo, a), *_mark(run)), None))
            else:
                p.candidates.append((b - 1, (*_left(mask, lo, a), *_mark(run)), _right(mask, after, hi)))
        if not body.isascii() and THAI.search(body):
            for m in GAP.finditer(mask, lo, hi):
                a, b = m.span()
                bare = mask[max(lo, a - 24) : a].rstrip(SUFFIX)
                left, right = _left(mask, lo, a), _right(mask, b, hi)
                if bare and bare[-1] not in MARKS and (left[1] == "T" or THAI_SIDE in right[2]):
                    p.candidates.append((a - 1, (*left, "gap", ""), right))
        yield p


def features(key: tuple, right: tuple) -> list[str]:
    """What the model sees of a candidate."""
    left, shape, mark, close = key
    one, two, kind = right
    return [
        "b", "m" + mark, "c" + close, "l" + left, "s" + shape, "r" + one, "2" + two, "k" + kind, "mk" + mark + kind, "ck" + close + kind,
        "sk" + shape + kind, "lk" + left + "|" + kind, "ms" + mark + shape, "mc2" + mark + close + "|" + two, "msk" + mark + shape + kind,
    ]


class Model:
    """Weights by feature; decisions are remembered by what the model sees."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def ends(self, key: tuple, right: tuple) -> bool:
        seen = (key, right)
        if (got := self.known.get(seen)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            w = self.weights
            got = self.known[seen] = sum(w.get(f, 0.0) for f in features(key, right)) > 0
        return got

    def sentence_ends(self, text: str) -> list[int]:
        out = []
        for p in cuts(text):
            own = {e for e, key, right in p.candidates if right is not None and self.ends(key, right)}
            own.add(p.last)
            out += sorted(own)
        return out


#: Examples that hold in any table, so that a table without Thai, or without reliable boundaries, has a model, too.
ALWAYS = [
    *((("", "T", "gap", ""), ("", "", o + THAI_SIDE), 1, 1.0) for o in ("", "q", "(")),
    *((("", shape, "gap", ""), ("", "", kind), 0, 1.0) for shape, kind in (("T", "digit"), ("T", "formula"), ("T", "display"), ("T", "reference"), ("T", "macro"), ("T", "Ll"), ("T", "LU"), ("T", "sign"))),
    *((("", shape, "gap", ""), ("", "", THAI_SIDE), 0, 1.0) for shape in ("int1", "int2", "int3", "int4", "number", "formula", "reference", "macro", "none", "Ll1", "Ll2", "Ll3", "Ll5", "LU1", "LU2", "LU3", "LU5", "Ldotted")),
    *((("", "", mark, ""), ("", "", ""), 1, 1.0) for mark in sorted(MARKS)),
]
PARTS = ("left", "shape", "mark", "close", "one", "two", "kind")
COUNTED = "what string, " + ", ".join(f"{c} string" for c in PARTS) + ", n bigint"


def counts(texts: Iterator[str]) -> Counter:
    """How often each candidate, paragraph end and paragraph start occurs: (what, left, shape, mark, close, one, two, kind)."""
    out: Counter = Counter()
    for t in texts:
        for p in cuts(t):
            out["start", "", "", "", "", *p.start] += 1
            for _, key, right in p.candidates:
                out[("end", *key, "", "", "") if right is None else ("inner", *key, *right)] += 1
    return out


def reliable(counted: dict[tuple, int], seen: int = SEEN) -> list[tuple[tuple, tuple, int, float]]:
    """(key, right, is boundary, weight) of the candidates that are told apart by paragraph ends and starts, and of gaps."""
    inner = {(k[1:5], k[5:]): n for k, n in counted.items() if k[0] == "inner"}
    ends, starts, n_left, n_right = Counter(), Counter(), Counter(), Counter()
    n_par = 0
    for (what, *k), n in counted.items():
        if what == "start":
            n_par += n
            starts["t" + k[4]] += n
            starts["t" + k[5]] += n  # figures and signs, whose two tokens are one, count twice: they start few paragraphs
            starts["s" + k[6]] += n
        elif what == "end":
            ends["t" + k[0] + k[2] + k[3]] += n
            ends["s" + k[1] + k[2] + k[3]] += n
    marked = {x: n for x, n in inner.items() if x[0][2] != "gap"}
    for (key, right), n in marked.items():
        n_left["t" + key[0] + key[2] + key[3]] += n
        n_left["s" + key[1] + key[2] + key[3]] += n
        n_right["t" + right[1]] += n
        n_right["t" + right[0]] += n if right[0] != right[1] else 0
        n_right["s" + right[2]] += n
    n_ends, n_starts = max(1, sum(v for k, v in ends.items() if k[0] == "s")), max(1, n_par)
    total = max(1, sum(marked.values()))

    def standing(tokens: tuple, known: Counter, inside: Counter, n_known: int) -> int:
        """By the first of the tokens that is known: 1 if it is met there, -1 if not, 0 in between."""
        for k in tokens:
            due = inside[k] * n_known / total  # how often it would be met if it were as any other
            if due >= MANY and known[k] < 0.1 * due:
                return -1
            if known[k] >= 2 and known[k] + inside[k] >= seen:
                return 1 if known[k] > 0.25 * due else 0
            if due >= MANY:
                return 0
        return 0

    out = []
    for (key, right), n in inner.items():
        if key[2] == "gap":
            out.append((key, right, int(key[1] == "T" and right[2].endswith(THAI_SIDE)), float(n)))
            continue
        tail = key[2] + key[3]
        left = standing(("t" + key[0] + tail, "s" + key[1] + tail), ends, n_left, n_ends)
        r = standing(("t" + right[1], "t" + right[0], "s" + right[2]), starts, n_right, n_starts)
        if left < 0 or r < 0:
            out.append((key, right, 0, float(n)))
        elif left > 0 and r > 0:
            out.append((key, right, 1, float(n)))
    return out


def fit(counted: dict[tuple, int], rounds: int = 200, ridge: float = 1e-4, least: int = 3) -> Model:
    """The maximum-entropy model of the reliable boundaries. Tokens met fewer than 'least' times are no features, so examples that differ in them alone are one."""
    examples = reliable(counted)
    met: Counter = Counter()
    for key, right, _, n in examples:
        for k in (("l", key[0]), ("r", right[0]), ("2", right[1])):
            met[k] += n
    known = lambda k, x: x if met[k, x] >= least else ""
    merged: Counter = Counter()
    for key, right, y, n in examples:
        merged[(known("l", key[0]), *key[1:]), (known("r", right[0]), known("2", right[1]), right[2]), y] += n ** 0.5
    for key, right, y, n in ALWAYS:
        merged[key, right, y] += n
    names: dict[str, int] = {}
    rows = sorted(merged.items(), key=repr)
    x = np.array([[names.setdefault(f, len(names)) for f in features(k, r)] for (k, r, _), _ in rows])
    y, weight = np.array([e[2] for e, _ in rows], float), np.array([n for _, n in rows])
    weight /= weight.sum()
    w, past = np.zeros(len(names)), np.full(len(names), 1e-8)
    flat = x.ravel()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(flat, np.repeat(weight * (p - y), x.shape[1]), len(names)) + ridge * w / len(names)
        past += g * g
        w -= 0.5 * g / np.sqrt(past)
    return Model({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-4})


def fitted(docs: DataFrame, size: int = FIT_DOCS) -> Model:
    """The model of about size documents, the same ones each time, spread over the table. Counts are made in tasks; the driver gets them added up."""
    share = max(1, docs.count() // size)
    t = docs.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(share)) == 0) if share > 1 else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COUNTED.split(", ")]
        for batch in batches:
            own = counts(x for x in batch.column(0).to_pylist() if x)
            if own:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*own, strict=True)), pa.array(list(own.values()), pa.int64())], names=names)

    counted = t.select("text").mapInArrow(run, COUNTED).groupBy("what", *PARTS).agg(F.sum("n").alias("n")).toArrow()
    columns = [c.to_pylist() for c in counted.columns]
    return fit(dict(zip(zip(*columns[:-1], strict=True), columns[-1], strict=True)))


def sentence_ends(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, sent_no, sent_end): the position of each sentence's last character."""
    weights = (model or fitted(docs)).weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value)
        for batch in batches:
            ids, numbers, ends = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    e = own.sentence_ends(t)
                    ids += [i] * len(e)
                    numbers += range(len(e))
                    ends += e
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(ends, pa.int64())], names=["doc_id", "sent_no", "sent_end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, sent_no int, sent_end bigint")
