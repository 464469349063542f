"""Noise in text from scanned pages: furniture found, words restored, lines joined to paragraphs.

1. Furniture. Lines that look like headings and come back on other pages of
   their file, though not in most files, are running headers; a number line is
   the printed page number if its distance to the page's own number is the
   file's usual one. Both are aggregations over (file, key), never a group of
   a file's text.
2. Lexicon. Counts of the words of all chunks, but for parts of words at line
   ends; those seen twice or more and making up ``RARE`` of all words are
   broadcast, which is two million words at most.
3. Decoding. The lines of a field without their furniture are one stream of
   tokens; a Viterbi search weighs, by the lexicon, leaving a token, correcting
   it through known confusions, parting it into any number of words, and joining
   it to the next ones over line ends (with the scan's hyphen, its own hyphen or
   none) or a blank. All thresholds are shares of the corpus.
4. Paragraphs. Their boundaries are the best path over the remaining lines.

Defined results: null, empty and blank fields have no damage and come back as
they are (null stays null); a null page number lets only marked numbers or such
beside a header count; repeated chunk ids are treated alike, row by row; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

FIELDS = ("text", "section_title")
#: Marks that scans show where a word is cut at a line end.
HYPHENS = "-‐‑‒–—¬­"
#: What print is taken for what by scanning, as (read, printed), with the cost of one such reading.
SYMBOL_CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("@", "a"), ("†", "t"), ("$", "s"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
    ("£", "e"), ("€", "e"), ("©", "c"), ("(", "c"), ("°", "o"), ("ſ", "s"),
)
LETTER_CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("t", "f"), ("f", "t"), ("l", "i"), ("i", "l"), ("i", "r"), ("r", "i"), ("u", "n"), ("n", "u"),
    ("o", "c"), ("o", "e"), ("e", "o"), ("a", "o"), ("o", "a"), ("i", "t"), ("l", "t"), ("t", "l"), ("i", "j"), ("j", "i"), ("v", "y"), ("y", "v"),
    ("q", "g"), ("g", "q"), ("s", "a"), ("f", "s"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("c1", "d"), ("d", "cl"), ("ii", "u"),
    ("u", "ii"), ("vv", "w"), ("w", "vv"), ("m", "in"), ("in", "m"), ("m", "ni"), ("m", "nn"), ("li", "h"), ("h", "li"), ("ii", "n"), ("n", "ii"),
    ("tt", "u"), ("lc", "k"), ("ni", "m"), ("nn", "m"), ("il", "u"), ("ti", "n"), ("j", "y"),
)
SYMBOL_COST, LETTER_COST = 1.0, 3.5
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def confusions() -> dict[str, list[tuple[str, float]]]:
    """What a reading may stand for, with its cost."""
    out: dict[str, list[tuple[str, float]]] = {}
    for pairs, cost in ((SYMBOL_CONFUSIONS, SYMBOL_COST), (LETTER_CONFUSIONS, LETTER_COST)):
        for read, printed in pairs:
            out.setdefault(read, []).append((printed, cost))
    return out


def is_word_char(c: str) -> bool:
    """Letters and the marks that belong to them."""
    return c.isalpha() or "ऀ" <= c <= "෿" and not c.isdigit() and c not in "।॥"


def core(token: str) -> str:
    """A token in lower case without punctuation at its edges; marks of reading errors inside stay."""
    a, b = 0, len(token)
    while a < b and not (is_word_char(token[a]) or token[a].isdigit() or token[a] in "@$†ﬁﬂ"):
        a += 1
    while b > a and not (is_word_char(token[b - 1]) or token[b - 1].isdigit() or token[b - 1] in "@$†ﬁﬂ"):
        b -= 1
    return token[a:b].lower()


def bare(word: str) -> str:
    """Without any punctuation."""
    return "".join(c for c in word if is_word_char(c) or c.isdigit())


#: Share of all words under which a form is no evidence of a word; it bounds the lexicon at two million forms.
RARE = 5e-7


class Lexicon:
    """Word counts with the readings that may stand for them. *floor* is the least count of a form in it: all evidence is measured by it, so a corpus and its multiple decide alike."""

    def __init__(self, counts: dict[str, int], floor: int = 2, keep: int = 200_000):
        self.counts, self.floor, self.keep = counts, floor, keep
        self.total = math.log(max(2, sum(counts.values())))
        self.unseen = math.log(0.15 * floor) - self.total
        self.most = max(counts.values(), default=0)
        self.words = sorted(counts)
        self.table = confusions()
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, tuple[str, float, bool]] = {}
        self.facts: dict[str, tuple] = {}
        self.parts: dict[str, tuple[float, str] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "facts": {}, "parts": {}}

    def known(self, form: str) -> int:
        return self.counts.get(form, 0)

    def prior(self, form: str) -> float:
        """Log probability of a form as it stands."""
        n = self.counts.get(form, 0)
        return math.log(n) - self.total if n else self.unseen

    def _open(self, prefix: str) -> bool:
        i = bisect_left(self.words, prefix)
        return i < len(self.words) and self.words[i].startswith(prefix)

    def candidates(self, form: str, most: float) -> dict[str, float]:
        """Words that the form may be a reading of, with their cost, at most *most*."""
        out: dict[str, float] = {}
        todo = [(0, "", 0.0)]
        best: dict[tuple[int, str], float] = {}
        while todo:
            at, prefix, cost = todo.pop()
            if at == len(form):
                if prefix in self.counts and cost < out.get(prefix, math.inf):
                    out[prefix] = cost
                continue
            steps = [(1, form[at], 0.0)]
            for width in (1, 2):
                steps += [(width, p, c) for p, c in self.table.get(form[at : at + width], ()) if at + width <= len(form)]
            for width, p, c in steps:
                if cost + c <= most:
                    to = (at + width, prefix + p)
                    if cost + c < best.get(to, math.inf) and self._open(to[1]):
                        best[to] = cost + c
                        todo.append((*to, cost + c))
        out.pop(form, None)
        return out

    def resolve(self, form: str) -> tuple[str, float, bool]:
        """(word, log probability, misread) that explains a form best."""
        got = self.seen.get(form)
        if got is None:
            own = self.prior(form)
            got = (form, own, False)
            n = self.counts.get(form, 0)
            letters = sum(map(is_word_char, form))
            code = re.fullmatch(r"\d+([a-z]|st|nd|rd|th)?|[ivxlc]+", form) is not None
            if 2 <= len(form) and letters and not (code and not (form[0] == "0" or n == 0 and letters)):
                symbols = len(form) - letters
                ranked = [(self.prior(w) - c, w) for w, c in self.candidates(form, SYMBOL_COST * symbols + LETTER_COST * (2 if len(form) > 4 else 1)).items()
                          if not w.isdigit() and (len(form) > 3 or self.known(w) > 50 * max(0.5 * self.floor, n))]
                if ranked:
                    p, w = max(ranked)
                    if p > own:
                        got = (w, p, True)
            if len(self.seen) >= self.keep:
                self.seen.clear()
            self.seen[form] = got
        return got

    def segmented(self, form: str) -> tuple[float, str] | None:
        """(log probability, words) of a form that runs words together: the best way to part it into frequent words of two letters and more."""
        if form not in self.parts:
            if len(self.parts) >= self.keep:
                self.parts.clear()
            n, least = len(form), 10 * self.floor
            longest = 24  # a longer word needs no partner to be told apart from it
            best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * n
            for j in range(2, n + 1):
                for i in range(max(0, j - longest), j - 1):
                    if best[i] is not None and (i or j < n) and self.counts.get(form[i:j], 0) > least:
                        p = best[i][0] + self.prior(form[i:j]) + (-SPLIT_COST if i else 0.0)
                        if best[j] is None or p > best[j][0]:
                            best[j] = (p, i)
            words, j = [], n
            while j and best[n] is not None:
                words.append(form[best[j][1] : j])
                j = best[j][1]
            self.parts[form] = (best[n][0], " ".join(words[::-1])) if words else None
        return self.parts[form]

    def fact(self, raw: str) -> tuple:
        """What a token is by itself, once for each: (form, word, log probability, misread, count of the form, letter at its end, may follow a cut, may go on a word, taken as it stands)."""
        got = self.facts.get(raw)
        if got is None:
            if len(self.facts) >= self.keep:
                self.facts.clear()
            form = core(raw)
            word, p, wrong = self.resolve(form) if form else ("", 0.0, False)
            first = raw[0]
            got = self.facts[raw] = (
                form, word, p, wrong, self.counts.get(form, 0), is_word_char(raw[-1]), bool(form) and (is_word_char(first) or first.isdigit() or first in "@$†"), first.islower() or not first.isupper(),
                not wrong and (not form or form in self.counts or len(form) <= 5 or not form.isalpha()),
            )
        return got


def _cut(raw: str) -> str:
    """How the last token of a line ends: "hyphen" with a mark after a letter, else "end"."""
    held = raw.rstrip(HYPHENS)
    return "hyphen" if len(held) < len(raw) and held and is_word_char(held[-1]) else "end"


def stream(lines: list[tuple[int, str]]) -> tuple[list[str], list[int], list[str]]:
    """(tokens, their lines, their cuts) of numbered lines, in order; a cut is "" within a line."""
    raws: list[str] = []
    at: list[int] = []
    cuts: list[str] = []
    for no, line in lines:
        words = line.split()
        if words:
            raws += words
            at += [no] * len(words)
            cuts += [""] * (len(words) - 1)
            cuts.append(_cut(words[-1]))
    return raws, at, cuts


JOIN_HYPHEN, KEEP_HYPHEN, JOIN_BARE, LEFT_HYPHEN, SPLIT_COST = 0.7, 0.7, 8.0, 6.0, 1.2


def _joins(raws: list[str], cuts: list[str], i: int, lex: Lexicon) -> list[tuple[int, float, str, bool, str]]:
    """(tokens, log probability, word, misread, kind) of the words that token *i* may begin together with those after it."""
    t, u = lex.fact(raws[i]), lex.fact(raws[i + 1])
    form, cut = t[0], cuts[i]
    if not form or not u[6]:
        return []
    out = []
    if cut == "hyphen":
        joined, width = form + u[0], 2
        w, p, wrong = lex.resolve(joined)
        # a word cut once more: a line that holds nothing but a middle part
        while not lex.known(w) and cuts[i + width - 1] == "hyphen" and i + width < len(raws) and lex.fact(raws[i + width])[6]:
            joined, width = joined + lex.fact(raws[i + width])[0], width + 1
            w, p, wrong = lex.resolve(joined)
        if lex.known(w):
            out.append((width, p - JOIN_HYPHEN * (width - 1), w, wrong, "broken"))
        else:
            # an unseen whole: more likely cut by the scan, unless both parts are words of their own
            joined = form + u[0]
            parts = t[4] > 0 and u[4] > 0 and raws[i][-1] == "-"
            if not parts and u[7]:
                out.append((2, lex.prior(joined) - JOIN_HYPHEN, joined, False, "broken"))
        hyphened = f"{form}-{u[0]}"
        w, p, wrong = lex.resolve(hyphened)
        if raws[i][-1] in "-‐‑":
            if lex.known(w):
                out.append((2, p - KEEP_HYPHEN, w, wrong, "own"))
            elif t[4] and u[4]:
                out.append((2, lex.prior(hyphened) - KEEP_HYPHEN - 1, hyphened, False, "own"))
    elif t[5] and u[7]:
        # without a mark, within a line or over its end: the whole must be far more frequent than its parts
        joined, width = form + u[0], 2
        low, high = min(t[4], u[4]), max(t[4], u[4])
        j = lex.known(joined)
        while not j and cut and cuts[i + width - 1] and i + width < len(raws) and (v := lex.fact(raws[i + width]))[6] and v[7] and lex.fact(raws[i + width - 1])[5] and width < 4:
            joined, low, high, width = joined + v[0], min(low, v[4]), max(high, v[4]), width + 1
            j = lex.known(joined)
        if j >= 1.5 * lex.floor and len(joined) > 3 and low < 0.01 * j and (cut or high < 0.05 * j):
            out.append((width, lex.prior(joined) - JOIN_BARE * (width - 1), joined, False, "broken" if cut else "blank"))
    return out


def decode(raws: list[str], cuts: list[str], lex: Lexicon, every: bool = True) -> list[tuple[int, int, str, bool, str]]:
    """Best path over tokens: (first token, number of tokens, word, misread, kind); kind is word, broken, own, blank or split.

    Tokens that no word of several tokens can hold are on every path, so the
    search is run over the others only, run by run. Tokens taken as they stand
    are left out of the path unless *every* is asked.
    """
    n = len(raws)
    fact_of = lex.facts.get
    facts = [fact_of(r) or lex.fact(r) for r in raws]
    out: list[tuple[int, int, str, bool, str]] = []
    count_of = lex.counts.get

    def alone(i: int) -> tuple[float, str, bool, str]:
        form, word, p, wrong, count, *_ = facts[i]
        left = p - (LEFT_HYPHEN if cuts[i] == "hyphen" and i + 1 < n else 0.0)
        if form and not count and not wrong and len(form) > 5 and form.isalpha() and (s := lex.segmented(form)) and s[0] > left:
            return s[0], s[1], False, "split"
        return left, word, wrong, "word"

    def tied(j: int) -> list[tuple[int, float, str, bool, str]]:
        t, u, cut = facts[j], facts[j + 1], cuts[j]
        # within a line only two tokens make a word, and it must be known
        if cut == "" and not (t[5] and u[7] and count_of(t[0] + u[0])):
            return []
        return _joins(raws, cuts, j, lex)

    i = 0
    while i < n:
        t = facts[i]
        if i + 1 == n or cuts[i] == "" and not (t[5] and count_of(t[0] + facts[i + 1][0])):
            if every or not t[8]:
                p, word, wrong, kind = alone(i)
                out.append((i, 1, word, wrong, kind))
            i += 1
            continue
        # a run: tokens that may be tied to the next one
        j, joins = i, {}
        reach = i
        while j + 1 < n and j <= reach:
            got = tied(j)
            if got:
                joins[j] = got
                reach = max(reach, j + max(g[0] for g in got) - 1)
            j += 1
        if not joins:
            p, word, wrong, kind = alone(i)
            out.append((i, 1, word, wrong, kind))
            i += 1
            continue
        end = reach + 1
        best, back = [0.0] + [-math.inf] * (end - i), [None] * (end - i + 1)
        for k in range(i, end):
            p, word, wrong, kind = alone(k)
            for width, gain, *step in [(1, p, word, wrong, kind), *joins.get(k, ())]:
                if best[k - i] + gain > best[k - i + width]:
                    best[k - i + width], back[k - i + width] = best[k - i] + gain, (k, width, *step)
        path, at = [], end - i
        while at:
            path.append(back[at])
            at = back[at][0] - i
        out += path[::-1]
        i = end
    return out


def damages(lines: list[tuple[int, str]], lex: Lexicon) -> set[tuple[int, str, str]]:
    """(line, kind, word) of broken and misread words."""
    raws, at, cuts = stream(lines)
    out = set()
    for i, _, word, wrong, kind in decode(raws, cuts, lex, every=False):
        if kind == "broken":
            out.add((at[i], "broken_word", bare(word)))
        if wrong:
            out.add((at[i], "misread", bare(word)))
    return out


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word


def _restored(raws: list[str], step: tuple[int, int, str, bool, str]) -> str:
    """Text of a step with the punctuation and case of its tokens."""
    i, width, word, wrong, kind = step
    first, last = raws[i], raws[i + width - 1]
    if kind == "word" and not wrong:
        return first.replace("­", "")
    lead = re.match(r"^[^\w@$†]*", first)[0]
    trail = last[len(last.rstrip(".,;:!?)।॥\"'”’]—")) :]
    return lead + _cased(word, first) + trail


_STARTS = re.compile(r"^(?:\(?[0-9]{1,4}[A-Za-z]?[.)]|\([a-zA-Z]{1,4}\)|[A-Z][A-Z ]{6,}$)")


def paragraphs(lines: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """Lines grouped to paragraphs by the best path: gains of a boundary, and a cost of unusual lengths."""
    full = [(no, s.strip(), i > 0 and not lines[i - 1][1].strip()) for i, (no, s) in enumerate(lines) if s.strip()]
    n = len(full)
    if not n:
        return []
    width = sorted(len(s) for _, s, _ in full)[-1 - n // 10]
    gain = [0.0] * (n + 1)
    for i in range(1, n):
        prev, line, blank = full[i - 1][1], full[i][1], full[i][2]
        ended = prev.rstrip("\"'”’)] ").endswith((".", ":", ";", "!", "?", "।", "॥", "—"))
        gain[i] = -1.5 + 3.0 * blank + (1.0 if ended else -2.5) + (1.0 if ended and len(prev) < 0.75 * width else 0.0)
        gain[i] += (2.0 if _STARTS.match(line) and ended else 0.0) - (2.0 if line[0].islower() else 0.0)
        gain[i] += 2.0 if _STARTS.match(prev) and prev.isupper() else 0.0
    # costs of a paragraph of n, n - 1 ... 1 lines; every earlier line may start one
    cost = np.array([0.15 * abs(math.log(k / 5)) for k in range(n, 0, -1)])
    best, back = np.zeros(n + 1), [0] * (n + 1)
    for j in range(1, n + 1):
        v = best[:j] + (gain[j] if j < n else 0.0) - cost[n - j :]
        back[j] = int(v.argmax())
        best[j] = v[back[j]]
    out, at = [], n
    while at:
        out.append([(no, s) for no, s, _ in full[back[at] : at]])
        at = back[at]
    return out[::-1]


def restore(lines: list[tuple[int, str]], lex: Lexicon) -> str:
    """Continuous text of lines, a blank line between paragraphs."""
    out = []
    for own in paragraphs(lines):
        raws, _, cuts = stream(own)
        out.append(" ".join(_restored(raws, s) for s in decode(raws, cuts, lex)))
    return "\n\n".join(out)


# Furniture

_NUM = r"([0-9]{1,5}|[ivxlcIVXLC]{1,7})"
_MARK = r"[\p{P}\p{S}\s]"
_OF = r"(?:\s*(?:of|/)\s*[0-9]{1,5})?"
_ONLY = rf"^{_MARK}*(?:(?i:page|pg|p|no)\.?\s+)?{_NUM}{_OF}{_MARK}*$"
_LEAD = rf"^{_MARK}*(?:(?i:page|pg|p|no)\.?\s+)?{_NUM}{_OF}{_MARK}*\s{{2,}}(\S.*\S)\s*$"
_TAIL = rf"^\s*(\S.*?\S)\s{{2,}}{_MARK}*(?:(?i:page|pg|p|no)\.?\s+)?{_NUM}{_OF}{_MARK}*$"
#: A number that ends a sentence, alone on its line.
_SENTENCE_END = r"[0-9ivxlc]\)?[.,;:]$"
#: Readings that one key takes together, for headers read differently on different pages; applied in this order.
_FOLDS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("in", "m"))


def _fold(c: Column) -> Column:
    x = F.translate(F.lower(c), "01l5@†f9q6b8†ce|", "oiisattgghhhteei")
    x = F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]", "")
    for a, b in _FOLDS:
        x = F.regexp_replace(x, a, b)
    return x


def roman(c: Column) -> Column:
    """Value of a roman numeral."""
    values = F.transform(F.split(F.lower(c), ""), lambda x: F.when(x == "i", 1).when(x == "v", 5).when(x == "x", 10).when(x == "l", 50).when(x == "c", 100).otherwise(0))
    return F.aggregate(
        values, F.struct(F.lit(0).alias("sum"), F.lit(1000).alias("last")),
        lambda a, v: F.struct((a["sum"] + v - F.when(v > a["last"], 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda a: a["sum"],
    )


#: A word in small letters, of which headings have none of over three letters.
_SMALL = r"(?:^|[^\p{L}\p{N}\p{S}@'’-])\p{Ll}[\p{L}\p{N}@†]{3,}"


def _maybe_furniture(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines without a word in small letters, and those that are a number or have a gap within."""
    for b in batches:
        chunk, file, page = b.columns[:3]
        for field, text in zip(FIELDS, b.columns[3:]):
            lists = pc.split_pattern(text, "\n")
            lines, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            first = np.ones(len(of), bool)
            first[1:] = of[1:] != of[:-1]
            no = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) + 1
            may = pc.or_(pc.invert(pc.match_substring_regex(lines, _SMALL)), pc.or_(pc.match_substring_regex(lines, r"\S\s\s+\S"), pc.match_substring_regex(lines, r"\s*" + _ONLY[1:-1] + r"\s*$")))
            may = pc.and_(may, pc.match_substring_regex(lines, r"\S"))
            at = np.flatnonzero(may.to_numpy(zero_copy_only=False))
            before = pa.array(np.where(first[at], 0, at - 1))
            yield pa.RecordBatch.from_arrays([
                chunk.take(pa.array(of[at])), file.take(pa.array(of[at])), page.take(pa.array(of[at])), pa.array([field] * len(at), pa.string()), pa.array(no[at], pa.int32()),
                lines.take(pa.array(at)), pc.if_else(pa.array(first[at]), "", lines.take(before)),
            ], names=["chunk_id", "source_file", "page", "field", "line_no", "s", "b"])


def lines_of(chunks: DataFrame) -> DataFrame:
    """Short lines with what they may hold of furniture: chunk_id, source_file, page, field, line_no, number, roman, alone, marked, style, key, cased."""
    x = chunks.select("chunk_id", "source_file", "page", *FIELDS).mapInArrow(_maybe_furniture, "chunk_id string, source_file string, page int, field string, line_no int, s string, b string")
    # no header or page number is longer
    x = x.withColumns({"s": F.trim("s"), "b": F.trim("b")}).where("length(s) between 1 and 120")
    only, lead, tail = F.regexp_extract("s", _ONLY, 1), *(F.when(F.col("s").rlike(r"\s\s"), F.regexp_extract("s", p, g)).otherwise("") for p, g in ((_LEAD, 1), (_TAIL, 2)))
    x = x.withColumn("only", only).withColumn("lead", F.when(F.col("only") == "", lead).otherwise("")).withColumn("tail", F.when((F.col("only") == "") & (F.col("lead") == ""), tail).otherwise(""))
    x = x.withColumn("digits", F.concat("only", "lead", "tail")).withColumn("head", F.when(F.col("only") != "", "").when(F.col("lead") != "", F.regexp_extract("s", _LEAD, 2)).when(F.col("tail") != "", F.regexp_extract("s", _TAIL, 1)).otherwise(F.col("s")))
    # like a heading: two letters and more in a row, no word of over three letters in small letters
    title = F.col("head").rlike(r"\p{L}.*\p{L}.*\p{L}") & ~F.col("head").rlike(r"(?<![\p{L}\p{N}\p{S}@'’-])\p{Ll}[\p{L}\p{N}@†]{3,}") & ~F.col("head").rlike(r"^\(?[0-9a-z]{1,4}[.)]\s")
    return x.select(
        "chunk_id", "source_file", "page", "field", "line_no", "s",
        F.when((F.col("digits") == "") | F.col("s").rlike(_SENTENCE_END), None).when(F.col("digits").rlike("^[0-9]"), F.col("digits").cast("int")).otherwise(roman("digits")).alias("number"),
        F.col("digits").rlike("^[a-zA-Z]").alias("roman"), (F.col("only") != "").alias("alone"),
        F.col("s").rlike(r"^[\p{P}\p{S}].*[0-9ivxlc]|[0-9ivxlc]\s*[\p{P}\p{S}]+$|(?i)^(?:page|pg|p)\.?\s").alias("marked"),
        F.when(F.col("only") != "", F.regexp_replace(F.regexp_replace("s", "[0-9]+|[ivxlcIVXLC]+", "9"), r"\s+\.$|\s", "")).otherwise("beside").alias("style"),
        F.when(title & ~F.col("b").rlike(r"(?i)^(?:chapter|part|schedule)\b.{0,8}$"), _fold(F.col("head"))).alias("key"), F.col("head").rlike(r"\p{Lu}").alias("cased"),
    ).where("number is not null or length(key) >= 6")


def furniture(chunks: DataFrame, common: float = 0.02) -> DataFrame:
    """(chunk_id, field, line_no, header, page_number) of the lines that hold furniture."""
    named = chunks.select("chunk_id", F.coalesce(F.col("source_file"), F.lit("")).alias("source_file"), F.col("page_number").cast("int").alias("page"), *FIELDS)
    lines = written(lines_of(named), "p3-lines")
    files = named.agg(F.approx_count_distinct("source_file")).first()[0]
    # headers: on two pages of the file and more, in few of the files
    # headers of scripts without case need more pages; section titles come back by their nature and are no evidence
    per = lines.where("length(key) >= 6 and field = 'text'").groupBy("source_file", "key").agg(
        F.count("*").alias("n"), (F.countDistinct("page") - F.when(F.max("cased"), 0).otherwise(2)).alias("pages"))
    spread = per.groupBy("key").agg(F.count("*").alias("files")).where(F.col("files") <= F.lit(max(2.0, common * files)))
    rare = per.join(spread, "key").select("source_file", "key", ((F.col("pages") >= 2) & (F.col("n") >= 2)).alias("returns"))
    # numbers: the usual distance to the page's own number
    shift = (
        lines.where("number is not null and page is not null").withColumn("shift", F.col("number") - F.col("page"))
        .groupBy("source_file", "roman", "style", "shift").agg(F.countDistinct("page").alias("pages"), F.sum(F.col("marked").cast("int")).alias("m"))
        .groupBy("source_file", "roman").agg(F.max_by(F.struct("shift", "pages", "style"), F.struct("pages", "m", -F.abs("shift"), "style")).alias("best"))
        .select("source_file", "roman", F.col("best.shift").alias("usual"), F.col("best.pages").alias("support"), F.col("best.style").alias("usual_style"))
    )
    x = lines.join(rare, ["source_file", "key"], "left").join(shift, ["source_file", "roman"], "left")
    x = x.withColumn("returns", F.coalesce("returns", F.lit(False))).withColumn("rare", F.col("key").isNotNull() & F.col("returns").isNotNull())
    fits = F.coalesce(F.col("number") - F.col("page") == F.col("usual"), F.lit(False))
    # beside: what the neighbouring line of the same field is
    w = Window.partitionBy("chunk_id", "field").orderBy("line_no").rowsBetween(-2, 2)
    near = lambda what: F.exists(F.collect_list(F.when(what, F.col("line_no"))).over(w), lambda y: F.abs(y - F.col("line_no")) == 1)
    alike = ~F.col("alone") | (F.col("usual_style") == "beside") | (F.col("style") == F.col("usual_style"))
    sure = F.coalesce(F.col("number").isNotNull() & fits & alike & (F.col("support") >= 2), F.lit(False))
    x = x.withColumn("sure", sure).withColumn("by_header", near(F.col("returns") & F.col("key").isNotNull())).withColumn("by_number", near(F.col("sure") & F.col("alone")))
    known = x.join(spread.select("key", F.lit(True).alias("few")), "key", "left")
    header = F.col("key").isNotNull() & (F.col("returns") | F.coalesce("few", F.lit(False)) & (F.col("by_number") | (F.col("sure") & ~F.col("alone"))))
    number = F.col("number").isNotNull() & (
        F.col("sure") | (fits | F.col("page").isNull() | (F.col("support") < 2)) & alike & F.col("alone") & (F.col("by_header") | F.col("marked"))
        | (~F.col("alone") & F.col("returns") & (fits | F.col("page").isNull()))
    ) & (F.col("alone") | F.col("key").isNotNull())
    return known.select("chunk_id", "field", "line_no", header.alias("header"), F.coalesce(number, F.lit(False)).alias("page_number")).where("header or page_number")


# Lexicon

#: Lines after a line end that may hold the rest of a word: furniture may stand between.
_REST = 3


def _edges(text: str) -> list[tuple[str, str, bool]]:
    """(first token, last token, whether they are one) of each line that has any."""
    return [(w[0], line.rsplit(None, 1)[-1], len(w) == 1) for line in text.split("\n") if (w := line.split(None, 1))]


def word_counts(texts: list[str | None], forms: dict[str, str], base: set[str] | frozenset[str] | None = None) -> dict[str, int]:
    """Counts of forms but for those at hyphens at line ends. With *base*, instead, how often to take off what stands at another line end and gives a word of *base* with the other side. *forms* remembers the form of a token."""
    def form(raw: str) -> str:
        f = forms.get(raw)
        if f is None:
            f = forms[raw] = core(raw)
        return f

    raws: Counter[str] = Counter()
    for text in texts:
        if not text:
            continue
        lines = _edges(text)
        # a line's tokens at its edges by their places, which are one if it has one token; furniture may stand between the parts
        hyphen: set[tuple[int, bool]] = set()
        joined: set[tuple[int, bool]] = set()
        for i, (_, last, one) in enumerate(lines):
            cut = _cut(last) == "hyphen"
            if not cut and base is None:
                continue
            for k in range(i + 1, min(len(lines), i + 1 + _REST)):
                if cut or form(last) + form(lines[k][0]) in base:
                    (hyphen if cut else joined).update(((i, not one), (k, False)))
        if base is None:
            raws.update(text.split())
            raws.subtract(lines[i][end] for i, end in hyphen)
        else:
            raws.update(lines[i][end] for i, end in joined - hyphen)
    seen: dict[str, int] = {}
    for raw, n in raws.items():
        f = form(raw)
        if n and f and not f.isdigit():
            seen[f] = seen.get(f, 0) + n
    return seen


def lexicon(chunks: DataFrame, rare: float = RARE) -> Lexicon:
    """The words of all chunks that are seen twice or more and make up the share *rare* of all words at least; so it holds at most 1 / rare words."""
    def counted(base: Broadcast | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forms: dict[str, str] = {}
            for b in batches:
                if len(forms) > 300_000:
                    forms.clear()
                seen = word_counts([t for c in b.columns for t in c.to_pylist()], forms, base.value if base else None)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

        return chunks.select(*FIELDS).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))

    def frequent(every: DataFrame) -> tuple[dict[str, int], int]:
        floor = max(2, math.ceil(rare * (every.agg(F.sum("n")).first()[0] or 0)))
        got = every.where(F.col("n") >= floor).toArrow()
        return dict(zip(got["w"].to_pylist(), got["n"].to_pylist())), floor

    first = written(counted(None), "p3-words")
    parts = counted(chunks.sparkSession.sparkContext.broadcast(frozenset(frequent(first)[0]))).withColumnRenamed("n", "off")
    whole = first.join(parts, "w", "left").select("w", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n"))
    return Lexicon(*frequent(written(whole, "p3-lexicon")))


def _plan(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = written(furniture(chunks), "p3-furniture")
    by_chunk = lines.groupBy("chunk_id").agg(F.collect_set(F.concat_ws(":", "field", "line_no")).alias("skip"))
    return lines, chunks.select("chunk_id", *FIELDS).join(by_chunk, "chunk_id", "left")


def _own_lines(text: str | None, field: str, skip: set[str]) -> list[tuple[int, str]]:
    return [(i, s) for i, s in enumerate((text or "").split("\n"), 1) if f"{field}:{i}" not in skip]


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, field, line_no, kind, word): each damage."""
    lines, rows = _plan(chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(lexicon(chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            out = []
            for chunk, text, title, skip in zip(*(c.to_pylist() for c in b.columns)):
                gone = set(skip or ())
                for field, value in (("text", text), ("section_title", title)):
                    out += [(chunk, field, *d) for d in damages(_own_lines(value, field, gone), lex)]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))],
                                             names=["chunk_id", "field", "line_no", "kind", "word"])

    words = rows.mapInArrow(run, "chunk_id string, field string, line_no int, kind string, word string")
    marks = lines.select("chunk_id", "field", "line_no", F.explode(F.array_compact(F.array(F.when(F.col("header"), "header"), F.when(F.col("page_number"), "page_number")))).alias("kind"), F.lit("").alias("word"))
    return words.union(marks)


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, section_title, text): words restored, furniture gone, lines joined to paragraphs."""
    _, rows = _plan(chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(lexicon(chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            ids, texts, titles = [], [], []
            for chunk, text, title, skip in zip(*(c.to_pylist() for c in b.columns)):
                gone = set(skip or ())
                ids.append(chunk)
                texts.append(None if text is None else restore(_own_lines(text, "text", gone), lex))
                titles.append(None if title is None else restore(_own_lines(title, "section_title", gone), lex).replace("\n\n", " "))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, titles, texts)], names=["chunk_id", "section_title", "text"])

    return rows.mapInArrow(run, "chunk_id string, section_title string, text string")
