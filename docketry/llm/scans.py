"""Texts of scanned pages back to running paragraphs."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.lookalikes import CYRILLIC_TWINS, GREEK_TWINS
from docketry.runtime import materialize, salted_join

# What a scanner's reader writes -> what the paper says.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("c", "e"), ("e", "c"), ("ii", "u"), ("u", "ii"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"),
    ("n", "ri"), ("ri", "n"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("l", "i"), ("i", "l"), ("0", "o"), ("5", "s"), ("1", "l"), ("1", "i"),
    ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("@", "a"), ("$", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("a", "o"), ("o", "a"), ("nn", "m"), ("in", "m"), ("ni", "m"),
)
_SEEN: dict[str, tuple[str, ...]] = {s: tuple(m for x, m in CONFUSIONS if x == s) for s, _ in CONFUSIONS}
#: A misread spelling must be this much rarer than the word it stands for.
RATIO = 12
#: Relative frequency from which words are kept, which bounds their table by its inverse; it lies below the share from which a word counts as known.
LEAST_SHARE = 2e-6
#: Number of words up to which word limits are counts; in larger corpora they grow in step, so that they stay shares.
WORDS = 840_000
_HYPHEN = "-‐‑­¬"
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BROKEN = re.compile(rf"([^\W\d_�!@|05)]+)[{_HYPHEN}][ \t]*$")
_TWINS = {ord(v): k for t in (CYRILLIC_TWINS, GREEK_TWINS) for k, v in t.items()}
#: What stands for letters that the reader lost: a glyph number, or replacement characters, one or more for a letter.
_LOST = re.compile(r"\(?cid:\d+\)?")
_NUMBER = re.compile(r"\$?(?:[\dlOIS]{1,3}(?:,[\dlOIS]{3})*|[\dlOIS]{4})(?:\.[\dlOIS]{2})?")
_DIGITS = str.maketrans("lIOS", "1105")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_EDGE = ".,;:()[]\"'?<>“”‘’…*"
_LINE_END = re.compile(rf"(\S*[\w�!@|)])[{_HYPHEN}]$")
_PAGE_NO = re.compile(r"^[\W_]*(?:(?:page|pg|p)\.?\s*)?[\divxlo]{1,6}(?:\s*(?:of|/)\s*[\dlio]{1,5})?[\W_]*$", re.I)
_STRONG_NO = re.compile(r"^\s*(?:-\s*[\dlIO]{1,5}\s*-|page\s+[\dlIOo]{1,5}(?:\s+of\s+[\dlIOo]{1,5})?)\s*$", re.I)
_STAMP_NO = re.compile(r"^\s*[A-Z]{2,4}[\dOlIS�]{5,9}\s*$")
_FAX = re.compile(r"^\s*FROM:.*\bP\.\s?[\dOlI�]+\s*$", re.I)


_SPACED = re.compile(r"(?:\S ){4,}.*")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_DAY = re.compile(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* [\dlOI]{1,2}, [\dlOI]{4}", re.I)
_CODE = re.compile(r"\b(?=\w*\d)\w+\b")
_CODES = re.compile(r"[#.,/:]*#[#.,/: ]*")
_REST = re.compile(r"[^\w#|�]+")
_FOLDS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"), ("c", "e"), ("f", "t"), ("b", "h"), ("0", "o"), ("5", "s"), ("!", "i"), ("@", "a"), ("l", "i"), ("|", "i"))


def mask(line: str) -> str:
    """A line without what changes from page to page: numbers, codes, dates; look-alike readings folded together."""
    s = line.strip()
    if "cid:" in s:
        s = _LOST.sub("", s)
    if _SPACED.fullmatch(s):  # s p a c e d  letters
        s = _BETWEEN.sub("", s)
    s = _CODES.sub("#", _CODE.sub("#", _DAY.sub("#", s)).lower())
    for a, b in _FOLDS:
        s = s.replace(a, b)
    return _REST.sub(" ", s).strip()


def edge_lines(lines: list[str]) -> tuple[set[int], int]:
    """Numbers of the first and last three lines that are not blank, and the longest line's length."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return set(full[:3] + full[-3:]), max((len(lines[i]) for i in full), default=0)


_SENTENCE_END = re.compile(rf"[{_HYPHEN}.;,:?!][\"')]?\s*$")


def _ends_sentence(line: str) -> bool:
    return bool(_SENTENCE_END.search(line))


class Reader:
    """Decodes lines with a lexicon of counts; results for tokens are kept."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.known, self.judged, self.parts, self.read = lexicon, {}, {}, {}, {}
        self.total = max(1, sum(lexicon.values()))
        self.scale = max(1.0, self.total / WORDS)
        self.words = sorted(lexicon)
        self.endings: list[str] = []

    # furniture -----------------------------------------------------------------------------------

    def is_furniture(self, line: str, seen: frozenset[str] = frozenset(), own: frozenset[str] = frozenset()) -> bool:
        m = mask(line)
        words = _LETTERS.findall(line)
        lower = sum(w[0].islower() for w in words) > 0.34 * len(words)
        if "#" not in m and lower:
            return False
        if m in seen or m in own and not lower:  # two pages alone do not tell a header from a sentence with other numbers
            return True
        if "�" in m:
            p = re.compile(re.sub("�+", ".{1,3}", re.escape(m).replace(re.escape("�"), "�")))
            return any(p.fullmatch(f) for f in seen)
        return False

    def running(self, lines: list[str], pages: bool, seen: frozenset[str] = frozenset(), own: frozenset[str] = frozenset()) -> set[int]:
        """Numbers of running headers, footers and page numbers; ``pages``: the text is one page, not several on end; ``seen``: the document's masks that the corpus tells to be furniture; ``own``: masks at the edges of several of its pages."""
        edge, _ = edge_lines(lines)
        out: set[int] = set()
        full = [i for i, x in enumerate(lines) if x.strip()]
        for k, i in enumerate(full):
            s = lines[i]
            if _FAX.match(s) or _STRONG_NO.match(s) or _STAMP_NO.match(s):
                out.add(i)
            elif (i in edge or not pages) and not _ends_sentence(s) and self.is_furniture(s, seen, own):
                out.add(i)
            elif _PAGE_NO.match(s) and (k in (0, 1) or k >= len(full) - 2):
                out.add(i)
        if not pages:  # a bare number beside another running line, or next in count to another page's number
            bare = lambda x: int(x.strip()) if x.strip().isdigit() and len(x.strip()) < 5 else None
            seen = {int(n) for i in out for n in re.findall(r"\b\d{1,4}\b", lines[i])}
            for k, i in enumerate(full):
                if i in out or not _PAGE_NO.match(lines[i]):
                    continue
                around = [full[j] for j in (k - 1, k + 1) if 0 <= j < len(full)]
                alone = all(not re.fullmatch(r"[\W\d]*", lines[j]) for j in around)
                n = bare(lines[i])
                if any(j in out for j in around) or (alone and n is not None and (n in seen or n + 1 in seen or n - 1 in seen)):
                    out.add(i)
                    seen.add(n if n is not None else -9)
        return out

    # words ---------------------------------------------------------------------------------------

    def count(self, word: str) -> int:
        return self.lexicon.get(word.lower(), 0)

    def walks(self, letters: str, start: int, most: int):
        """(end, word, confusions) of all known words that the letters from ``start`` on may be, with at most ``most`` confusions.

        The sorted words are walked like a tree of prefixes, so a reading goes on only while some word begins
        so; neither the length of the letters nor the number of readings is limited.
        """
        words, n = self.words, len(letters)
        stack = [(start, "", 0, 0, len(words))]
        while stack:
            i, built, made, lo, hi = stack.pop()
            if built and words[lo] == built:
                yield i, built, made
            if i == n:
                continue
            steps = [(1, letters[i], 0)]
            if made < most:
                steps += [(k, meant, 1) for k in (1, 2) for meant in _SEEN.get(letters[i : i + k], ()) if i + k <= n]
            for k, put, cost in steps:
                longer = built + put
                a = bisect_left(words, longer, lo, hi)
                b = bisect_left(words, longer + "\U0010ffff", a, hi)
                if a < b:
                    stack.append((i + k, longer, made + cost, a, b))

    def candidates(self, word: str, depth: int = 2):
        """(confusions, spelling) of a token with up to ``depth`` confusions undone, known or not; for tokens with lost letters only, whose other letters are few."""
        layer = {word}
        for d in range(depth):
            layer = {w[:i] + meant + w[i + n :] for w in layer for n in (1, 2) for i in range(len(w) - n + 1) for meant in _SEEN.get(w[i : i + n], ())}
            yield from ((d + 1, c) for c in layer)

    def meant(self, word: str) -> str:
        """The word the paper says: the likeliest of the spelling itself and its confusions (Viterbi over the word's lattice)."""
        w = word.lower()
        if (got := self.known.get(w)) is not None:
            return got
        if len(self.known) > 300_000:
            self.known.clear()
        if "�" in w:
            best = self.known[w] = self.wild(w)
            return best
        own = self.lexicon.get(w, 0)
        best, need = w, 0.0
        for end, c, edits in self.walks(w, 0, 2 if own < 8 * self.scale else 1):
            if end < len(w) or c == w:
                continue
            n = self.lexicon[c]
            if n >= 3 * self.scale and n > RATIO ** edits * max(own, (0.25 if not w.isalpha() else 0.4) * self.scale) and n / 4**edits > need and (len(c) > 3 or n > 30 * max(self.scale, own)):
                best, need = c, n / 4**edits
        self.known[w] = best
        return best

    def _fitting(self, w: str) -> list[str]:
        """Words that begin or end as ``w`` does around its lost letters."""
        if not self.endings:
            self.endings = sorted(x[::-1] for x in self.lexicon)
        head, tail = w[: w.index("�")], w[w.rindex("�") + 1 :][::-1]
        a, b = (bisect_left(self.words, x) for x in (head, head + "\U0010ffff"))
        c, d = (bisect_left(self.endings, x) for x in (tail, tail + "\U0010ffff"))
        return self.words[a:b] if b - a <= d - c else [x[::-1] for x in self.endings[c:d]]

    def wild(self, w: str) -> str:
        """The likeliest word with one to three letters for each run of lost ones, else with a confusion besides; ``w`` itself if none fits.

        Every letter beyond the run's length costs a factor of 4, like a confusion in ``meant``.
        """
        if not re.search(r"[^\W\d_]", w) or re.search(r"[\d_]", w):
            return w
        runs = [len(x) for x in re.findall("�+", w)]
        best, need = w, 0.0
        for edits, c in [(0, w), *(self.candidates(w, 1) if len(re.findall(r"[^\W\d_]", w)) > 3 else ())]:
            if edits and need:
                break
            pattern = re.compile(re.sub("�+", lambda m: rf"([^\W\d_]{{1,{max(3, len(m[0]))}}})", re.escape(c)))
            for x in self._fitting(c):
                if 0 <= len(x) - len(c) + sum(runs) <= sum(max(3, r) for r in runs) and (n := self.lexicon[x]) >= 3 * self.scale and n > need and (m := pattern.fullmatch(x)):
                    n /= 4 ** sum(max(0, len(g) - r) for g, r in zip(m.groups(), runs))
                    if n > need:
                        best, need = x, n
        return best

    def wrong(self, token: str) -> bool:
        """Whether a token holds a character that is not what the paper says; answers are kept."""
        got = self.judged.get(token)
        if got is None:
            if len(self.judged) > 300_000:
                self.judged.clear()
            got = self.judged[token] = self._wrong(token)
        return got

    def off(self, token: str) -> bool:
        """``wrong`` for a token that may end in a hyphen of its line."""
        got = self.judged.get(token)
        if got is None or token[-1] in _HYPHEN:
            got = self.wrong(token.rstrip(_HYPHEN) or token)
        return got

    def _wrong(self, token: str) -> bool:
        if "�" in token or "cid:" in token:
            return True
        core = token.strip(_EDGE)
        if not core or core == "|":
            return False
        if not core.isascii() and any(ord(c) in _TWINS for c in core) and any("a" <= c.lower() <= "z" for c in core):
            return True
        if any(c.isdigit() for c in core):
            if _NUMBER.fullmatch(core) and re.search(r"[lOIS]", core) and (core[0] == "$" or re.search(r"\d", core)):
                return not re.search(r"[A-Z]{2}", core)
            if re.fullmatch(r"(?:[^\W\d_]+[-'’])*(?:[^\W\d_]*\d[^\W\d_]+|[^\W\d_]+\d[^\W\d_]*)(?:\d?[^\W\d_]+)*(?:[-'’][^\W\d_]+)*", core):
                return any(self.meant(p) != p.lower() for p in re.split("[-'’]", core) if re.search(r"\d", p))
            return False
        if re.search(r"[!@|$]", core[:-1]) or core[-1] in "@|" or (core[-1] == "!" and len(core) > 2):
            return "." not in core and self.meant(core.replace("’", "'")) != core.lower() or any(self.meant(p) != p.lower() for p in core.split("-") if re.search(r"[!@|$]", p))
        if self.count(core) >= 3 * self.scale and "-" in core:
            own = self.count(core)
            return any(self.meant(p) != p.lower() for p in core.split("-")) and own < 30 * self.scale
        return any(self.meant(p) != p.lower() for p in re.split(r"[-/'’]|—", core) if len(p) > 1 and p.isalpha())

    # stream --------------------------------------------------------------------------------------

    def _cost(self, word: str) -> float:
        return -math.log((self.lexicon.get(word.lower(), 0) + 0.01 * self.scale) / self.total)

    def _token(self, token: str) -> tuple[str, bool]:
        """The token without the signs at its ends, lost letters as one sign, and whether it is a word that is not known; answers are kept."""
        if len(self.read) > 300_000:
            self.read.clear()
        core = (_LOST.sub("�", token) if "cid:" in token else token).strip(_EDGE)
        got = self.read[token] = (core, core.replace("�", "").isalpha() and self.count(core) < 3 * self.scale)
        return got

    def _single(self, core: str) -> float:
        if self.count(core) >= 3 * self.scale or not core.replace("�", "").isalpha():
            return self._cost(core)
        meant = self.meant(core)
        return self._cost(meant) + 4 if meant != core.lower() else 16.0 + max(0, len(core) - 8)  # an unknown word is the less likely the longer it is

    def spelled(self, letters: str) -> tuple[float, list[str], int]:
        """(cost, words, confusions) of the cheapest reading of letters as two or more frequent words, blanks left out; infinite cost if there is none.

        Viterbi over the places between the letters: every word is a walk through the lexicon from one place
        to another, with one confusion in words of four letters or more. Each confusion and each blank put
        in costs 4. Words of one or two letters must be among the most frequent.
        """
        w = letters.lower()
        if (got := self.parts.get(w)) is not None:
            return got
        if len(self.parts) > 300_000:
            self.parts.clear()
        best: list[tuple[float, list[str], int]] = [(0.0, [], 0)] + [(math.inf, [], 0)] * len(w)
        for i in range(len(w)):
            if best[i][0] == math.inf:
                continue
            cost, words, made = best[i]
            for end, word, edits in self.walks(w, i, 1):
                count = self.lexicon[word]
                if count < 20 * self.scale or edits and len(word) < 4 or len(word) < 3 and count < 400 * self.scale or not word.isalpha() or end - i == len(w):
                    continue
                c = cost + self._cost(word) + 4 * edits + 4 * bool(words)
                if c < best[end][0]:
                    best[end] = (c, [*words, word], made + edits)
        self.parts[w] = best[-1] if len(best[-1][1]) > 1 else (math.inf, [], 0)
        return self.parts[w]

    def segment(self, tokens: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
        """Segmentation of a stream of (token, line) into (kind, first token, end).

        Kinds: ``word``, one token as one word; ``join``, a word broken at a line's end; ``keep``, a word with
        a hyphen of its own at a line's end; ``merge``, one word with a blank too many; ``split``, several words
        with blanks too few; ``shift``, two tokens whose letters are several words with other bounds. Words
        may hold confusions in all of them. Known words are certain, so the search (Viterbi under word costs;
        a confusion, and a blank more or less, costs 4) runs over the stretches of tokens between them, with
        the known words beside them.
        """
        n, out, i = len(tokens), [], 0
        seen = [self.read.get(t) or self._token(t) for t, _ in tokens]
        cores = [core for core, _ in seen]
        doubtful = [unknown for _, unknown in seen]
        ends = [False] * n
        for k in range(n - 1):
            if tokens[k + 1][1] != tokens[k][1] and tokens[k][0][-1] in _HYPHEN and _LINE_END.search(tokens[k][0]):
                ends[k] = doubtful[k] = True
        while i < n:
            if not doubtful[i]:
                out.append(("word", i, i + 1))
                i += 1
                continue
            j = i
            while j < n and doubtful[j]:
                j += 1
            hi = min(n, j + 1)
            if out and out[-1] == ("word", i - 1, i) and tokens[i - 1][1] == tokens[i][1] and tokens[i - 1][0] == cores[i - 1] and cores[i - 1].isalpha() and cores[i].isalpha():
                out.pop()
                i -= 1
            best: list[tuple[float, int, str]] = [(0.0, i, "")] + [(math.inf, i, "")] * (hi - i)

            def arc(a: int, b: int, cost: float, kind: str, i=i, best=best) -> None:
                if best[a - i][0] + cost < best[b - i][0]:
                    best[b - i] = (best[a - i][0] + cost, a, kind)

            for k in range(i, hi):
                core = cores[k]
                if ends[k] and k + 1 < hi:
                    arc(k, k + 2, 0.0, "join" if self.breaks(_LINE_END.search(tokens[k][0])[1], tokens[k + 1][0]) else "keep")
                    continue
                arc(k, k + 1, self._single(core), "word")
                if core.isalpha() and self.count(core) < 3 * self.scale and self.meant(core) == core.lower():
                    arc(k, k + 1, self.spelled(core)[0], "split")
                if k + 1 < hi and tokens[k][1] == tokens[k + 1][1] and tokens[k][0] == core and core.isalpha() and cores[k + 1].isalpha() and (self.count(core) < 3 * self.scale or self.count(cores[k + 1]) < 3 * self.scale):
                    both = core + cores[k + 1]
                    if self.count(both) >= 20 * self.scale:
                        arc(k, k + 2, self._cost(both) + 4, "merge")
                    cost, words, made = self.spelled(both)
                    if words and made == 0 and words != [core.lower(), cores[k + 1].lower()]:
                        arc(k, k + 2, cost + 4, "shift")
                elif k + 1 < hi and tokens[k][1] == tokens[k + 1][1] and "�" in core + cores[k + 1] and tokens[k][0][-1:] not in _EDGE + "-" and all(self.count(x) < 3 * self.scale and self.meant(x) == x.lower() for x in (core, cores[k + 1])):
                    both = core + cores[k + 1]  # letters lost and a blank too many
                    if sum(c.isalpha() for c in both) > 3 and both.replace("�", "").isalpha() and (meant := self.meant(both)) != both.lower() and self.count(meant) >= 20 * self.scale:
                        arc(k, k + 2, self._cost(meant) + 8, "merge")
            path, e = [], hi
            while e > i:
                _, b, kind = best[e - i]
                path.append((kind, b, e))
                e = b
            out += reversed(path)
            i = hi
        return out

    # lines ---------------------------------------------------------------------------------------

    def breaks(self, head: str, tail: str) -> bool:
        """Whether ``head``- / ``tail`` is one word that was broken because the line was full.

        The joined and the hyphenated reading are compared as segmentations: by their counts in running
        lines, each also with the confusions it may hold.
        """
        head, tail = _LOST.sub("�", head), _LOST.sub("�", tail)
        a = re.split(r"[^\w'’�!@|-]", head)[-1].lower()
        b = re.match(r"[\w'’�!@|-]*", tail.lstrip("\"'(")).group(0).lower()
        if not b or not a:
            return False
        first, last = a.split("-")[-1], b.split("-")[0]
        joined = max(self.count(first + last), self.count(self.meant(first + last)))
        hyph = max(self.count(f"{a}-{b}"), self.count(f"{first}-{last}"), self.count(f"{first}-{b}"), self.count(f"{a}-{last}"))
        if joined or hyph:
            return joined > hyph
        if self.count(first) >= 20 * self.scale and self.count(last) >= 20 * self.scale and len(first) > 3 and len(last) > 3:
            return False
        return b[0].islower() or not b[0].isalpha()

    def defects(self, text: str, after: str | None, pages: bool, seen: frozenset[str] = frozenset(), own: frozenset[str] = frozenset()) -> list[tuple[int, str]]:
        """(line number, defect) of one text; ``after`` is the beginning of the next page."""
        lines = text.split("\n")
        run = self.running(lines, pages, seen, own)
        out = [(i + 1, "running") for i in run]
        body = [i for i, x in enumerate(lines) if x.strip() and i not in run]
        rest = None
        if after:
            follow = after.split("\n")
            skip = self.running(follow, pages, seen, own)
            rest = next((x for i, x in enumerate(follow) if x.strip() and i not in skip), None)
        stream = [(t, i) for i in body for t in lines[i].split()]
        if rest and rest.split():
            stream.append((rest.split()[0], -1))
        broken, misread = set(), set()
        for kind, b, e in self.segment(stream):
            token, line = stream[b]
            if kind == "word":
                if self.off(token):
                    misread.add(line)
            elif kind == "join":
                head, tail = _LINE_END.search(token)[1], stream[b + 1]
                broken.add(line)
                if self._part_wrong(head, tail[0], second=False):
                    misread.add(line)
                if self._part_wrong(head, tail[0], second=True):
                    misread.add(tail[1])
            elif kind in ("merge", "shift") or kind == "split" and self.spelled(_LOST.sub("�", token).strip(_EDGE))[2]:
                misread.add(line)
            elif kind == "keep":
                misread.update(at for t, at in stream[b:e] if self.off(t))
        if stream and stream[-1][1] >= 0 and (m := _LINE_END.search(stream[-1][0])) and self.breaks(m[1], "x"):
            broken.add(stream[-1][1])  # the rest is on a page that is not there
        out += [(i + 1, "misread") for i in sorted(misread) if i >= 0] + [(i + 1, "hyphen") for i in sorted(broken)]
        return out

    def _part_wrong(self, head: str, tail: str, second: bool) -> bool:
        """Whether the first or second part of a broken word holds the misread character."""
        part = tail if second else head
        if "�" in part or "cid:" in part or any(ord(c) in _TWINS for c in part) and re.search("[A-Za-z]", part):
            return True
        a = re.split(r"[^\w'’!@|]", head)[-1].lower()
        b = re.match(r"[\w'’!@|]*", tail).group(0).lower()
        word = a + b
        meant = self.meant(word)
        if meant == word:
            return False
        # the part whose own letters do not stand in the meant word
        return not meant.endswith(b) if second else not meant.startswith(a)

    # paragraphs ----------------------------------------------------------------------------------

    def repair_token(self, token: str) -> str:
        """The token as the paper has it. Lost letters of which no word tells stay marked, and so do lost digits."""
        bare = _LOST.sub("�", token)
        core = bare.strip(_EDGE)
        if not core or not self.wrong(token):
            return token
        if _NUMBER.fullmatch(core):
            return bare.replace(core, core.translate(_DIGITS), 1)
        cased = lambda new, old: new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() or old[0] == "�" and old[1:].isupper() else new
        plain = core.translate(_TWINS)
        if (fixed := self.meant(plain)) != core.lower():
            fixed = cased(fixed, core)
        elif plain[-1] in _HYPHEN:  # the first part of a word
            return token
        else:  # its parts one by one
            fixed = "".join(cased(m, x) if x and (m := self.meant(x)) != x.lower() else x for x in re.split(r"([-/'’—])", plain))
        return token if "�" in fixed else bare.replace(core, fixed, 1)

    def paragraphs(self, text: str, pages: bool) -> list[str]:
        """The running paragraphs of one text."""
        return [x for _, x in self.document([text], pages)]

    def _spaced(self, core: str) -> str:
        """The words that ``spelled`` finds in letters, their own letters kept where none was misread."""
        _, words, made = self.spelled(core)
        if made:
            text = " ".join(words)
            return text.upper() if core.isupper() else text[:1].upper() + text[1:] if core[:1].isupper() else text
        out, at = [], 0
        for w in words:
            out.append(core[at : at + len(w)])
            at += len(w)
        return " ".join(out)

    def document(self, texts: list[str], pages: bool, seen: frozenset[str] = frozenset(), furniture: frozenset[str] = frozenset()) -> list[tuple[int, str]]:
        """(number of the text it begins in, paragraph) of texts that follow one another: furniture out, broken words joined, misread words repaired, boundaries by dynamic programming.

        Every gap between two lines is either a boundary or none, also where a page ends. Boundaries cost less
        at blank lines, after short lines that end a sentence and before capitals; paragraphs of under two
        lines cost extra. A text without any line may hold what is missing, so a paragraph ends there.
        """
        lines: list[str] = []
        body: list[int] = []
        page_of: dict[int, int] = {}
        width_of: dict[int, int] = {}
        apart: set[int] = set()  # lines that begin a paragraph because the page before has none
        full = True
        for no, text in enumerate(texts):
            own = text.split("\n")
            run = self.running(own, pages, seen, furniture)
            kept = [i for i, x in enumerate(own) if x.strip() and i not in run]
            width = max((len(own[i].rstrip()) for i in kept), default=0)
            for i in kept:
                page_of[len(lines) + i], width_of[len(lines) + i] = no, width
            if kept and not full:
                apart.add(len(lines) + kept[0])
            body += [len(lines) + i for i in kept]
            lines += own
            full = bool(kept)
        if not body:
            return []
        n = len(body)
        gap = [0.0] * n  # cost of a boundary before line k less that of none
        for k in range(1, n):
            before, here = lines[body[k - 1]].rstrip(), lines[body[k]].strip()
            blank = page_of[body[k - 1]] == page_of[body[k]] and any(not lines[j].strip() for j in range(body[k - 1] + 1, body[k]))
            ends = bool(re.search(r"[.?!:][\"')]?$", before))
            gap[k] = 2.0 - 3.0 * blank - 1.5 * (ends and len(before) < 0.75 * width_of[body[k - 1]]) + (0.0 if here[:1].isupper() or here[:1].isdigit() else 3.0) + (0.0 if ends else 1.5)
            if body[k] in apart:
                gap[k] = -1e6
        # the cheapest beginning of a paragraph that ends before line e, over all lines: the last line alone, or the best of all earlier ones
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        low, at = math.inf, 0
        for e in range(1, n + 1):
            if e > 1 and (c := best[e - 2] + gap[e - 2]) < low:
                low, at = c, e - 2
            alone = best[e - 1] + gap[e - 1] + 0.3
            best[e], back[e] = (low, at) if low <= alone else (alone, e - 1)
        spans, e = [], n
        while e:
            spans.append((back[e], e))
            e = back[e]
        out = []
        for s, e in reversed(spans):
            stream = [(t, body[k]) for k in range(s, e) for t in lines[body[k]].split()]
            words: list[str] = []
            for kind, b, f in self.segment(stream):
                t = stream[b][0]
                if kind == "join":
                    words.append(self.repair_token(_LINE_END.search(t)[1] + stream[b + 1][0]))
                elif kind == "keep":
                    words.append(self.repair_token(t + stream[b + 1][0]))
                elif kind == "merge":
                    words.append(self.repair_token(t + stream[b + 1][0]))
                elif kind in ("split", "shift"):
                    core = "".join(x.strip(_EDGE) for x, _ in stream[b:f])
                    put = self._spaced(core)
                    words.append(t.replace(core, put, 1) if kind == "split" else put + stream[f - 1][0][len(stream[f - 1][0].rstrip(_EDGE)) :])
                else:
                    words.append(self.repair_token(t))
            out.append((page_of[body[s]], " ".join(words)))
        return out


#: Lines that are running wherever they stand, as ``Reader.running`` takes them.
_ALWAYS = r"(?i)^\s*(?:-\s*[\dlIO]{1,5}\s*-|page\s+[\dlIOo]{1,5}(?:\s+of\s+[\dlIOo]{1,5})?)\s*$|(?-i)^\s*[A-Z]{2,4}[\dOlIS�]{5,9}\s*$|(?i)^\s*FROM:.*\bP\.\s?[\dOlI�]+\s*$"


def page_texts(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(src, row_id, text, after, pages, doc, page, seen, own): pages of PDF files with the beginning of the next page, and image texts, each with its document's running lines.

    The beginning is all that may be a running line at the top (three lines, and any number of lines that are
    running wherever they stand) and the first line below it; short pages are taken whole. It and the running
    lines are put together by keys first, so that a page's text is shuffled once.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    below = F.filter(F.slice(lines, 4, F.greatest(F.size(lines), F.lit(1))), lambda x: ~x.rlike(_ALWAYS))
    filler = F.array_repeat(F.lit("x x."), 4)  # keeps the lines before from standing at the page's lower edge
    head = F.array_join(F.when(F.size(lines) <= 8, lines).otherwise(F.concat(F.slice(lines, 1, 3), F.slice(below, 1, 1), filler)), "\n")
    known = materialize(furniture_of(pages, results))
    of_pages = known.where(F.col("src") == "page_results").select(F.col("doc").alias("extraction_id"), "seen", "own")
    keys = pages.select(F.col("page_id").alias("row_id"), "extraction_id", "page_number")
    heads = pages.groupBy("extraction_id", (F.col("page_number") - 1).alias("page_number")).agg(F.min_by(head, "page_id").alias("after"))
    side = salted_join(keys.join(heads, ["extraction_id", "page_number"], "left"), of_pages, ["extraction_id"], "left", salt_on=F.col("row_id"))
    side = side.select("row_id", "after", F.lit(True).alias("pages"), F.col("extraction_id").alias("doc"), F.col("page_number").alias("page"), "seen", "own")
    left = pages.select(F.lit("page_results").alias("src"), F.col("page_id").alias("row_id"), "text").join(side, "row_id")
    images = results.where(F.col("method").startswith("tesseract")).select(F.lit("extraction_results").alias("src"), F.col("extraction_id").alias("row_id"), "text", F.lit(None).cast("string").alias("after"), F.lit(False).alias("pages"))
    of_images = known.where(F.col("src") != "page_results").select(F.col("doc").alias("row_id"), "seen", "own")
    right = images.join(of_images, "row_id", "left").withColumn("doc", F.lit(None).cast("bigint")).withColumn("page", F.lit(None).cast("int"))
    none = F.array().cast("array<string>")
    return left.unionByName(right).withColumns({"text": F.coalesce("text", F.lit("")), "seen": F.coalesce("seen", none), "own": F.coalesce("own", none)})


def lexicon(texts: DataFrame) -> dict[str, int]:
    """Counts of words and hyphenated words inside lines, over all texts, from three occurrences on.

    Words under a share of ``LEAST_SHARE`` of all words are left out, so the table has at most
    1 / LEAST_SHARE rows, whatever the corpus. Word parts at broken lines are not counted.
    """
    clean = F.regexp_replace("text", rf"\S+[{_HYPHEN}][ \t]*\n\s*\S+", " ")
    words = F.regexp_extract_all(F.lower(clean), F.lit(r"(?U)(?<![\w�)(@!])(\p{L}+(?:['’-]\p{L}+)*)(?![\w�(@!])"), F.lit(1))
    counts = texts.select(F.explode(words).alias("word")).groupBy("word").count()
    counts = materialize(counts)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first().n
    return {r.word: r["count"] for r in counts.where((F.col("count") >= 3) & (F.col("count") >= LEAST_SHARE * total)).collect()}


def furniture_of(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(src, doc, seen, own): masks of running lines of every document and image text; other documents have no row.

    ``seen``: masks that stand at the edges of pages three times or more in the corpus, and hardly ever
    elsewhere. ``own``: masks at the edges of two or more pages of the document itself, whatever the corpus.
    All lines are counted by a hash of their mask, combined in each partition; what the counts tell is
    joined back to the lines at edges by the hash, spread over salts, so nothing is collected and no share of
    the corpus is asked for. The masks of one document are gathered, which is the document's own size.
    """
    kept = pages.where(F.col("extraction_id").isNotNull() & F.col("text").isNotNull()).select(F.lit("page_results").alias("src"), F.col("extraction_id").alias("doc"), "text")
    images = results.where(F.col("method").startswith("tesseract") & F.col("text").isNotNull()).select(F.lit("extraction_results").alias("src"), F.col("extraction_id").alias("doc"), "text")
    letters = lambda m: sum("a" <= c <= "z" for c in m) >= 4

    def count(batches):
        import pandas as pd
        import xxhash

        edge, every = Counter(), Counter()
        for b in batches:
            for text in b["text"]:
                lines = text.split("\n")
                at, _ = edge_lines(lines)
                for i, x in enumerate(lines):
                    if x.strip() and not _ends_sentence(x) and (m := mask(x)):
                        h = xxhash.xxh64_intdigest(m) - (1 << 63)
                        every[h] += 1
                        edge[h] += i in at
            if len(every) > 200_000:
                yield pd.DataFrame({"h": list(every), "edge": [edge[h] for h in every], "n": list(every.values())}).astype("int64")
                edge.clear()
                every.clear()
        yield pd.DataFrame({"h": list(every), "edge": [edge[h] for h in every], "n": list(every.values())}).astype("int64")

    def lines_of(batches):
        import pandas as pd
        import xxhash

        for b in batches:
            rows = []
            for src, doc, text in zip(b["src"], b["doc"], b["text"]):
                lines = text.split("\n")
                at = edge_lines(lines)[0] if src == "page_results" else range(len(lines))
                found = {mask(lines[i]) for i in at if lines[i].strip() and not _ends_sentence(lines[i])}
                rows += [(src, doc, m, xxhash.xxh64_intdigest(m) - (1 << 63)) for m in found if letters(m)]
            yield pd.DataFrame(rows, columns=["src", "doc", "mask", "h"]).astype({"doc": "int64", "h": "int64", "src": object, "mask": object})

    counts = kept.select("text").mapInPandas(count, "h bigint, edge bigint, n bigint").groupBy("h").agg(F.sum("edge").alias("edge"), F.sum("n").alias("n"))
    known = counts.where((F.col("edge") >= 3) & (F.col("edge") >= 0.85 * F.col("n"))).select("h", F.lit(True).alias("seen"))
    lines = kept.unionByName(images).mapInPandas(lines_of, "src string, doc bigint, mask string, h bigint")
    per = lines.groupBy("src", "doc", "mask", "h").agg(F.count("*").alias("n"))
    judged = salted_join(per, known, ["h"], "left", salt_on=F.col("doc"))
    seen = F.collect_set(F.when(F.col("seen"), F.col("mask")))
    own = F.collect_set(F.when((F.col("n") >= 2) & (F.col("src") == "page_results"), F.col("mask")))
    return judged.where(F.col("seen") | (F.col("n") >= 2)).groupBy("src", "doc").agg(seen.alias("seen"), own.alias("own"))


def _reader(pages: DataFrame, results: DataFrame):
    words = pages.select("text").unionByName(results.select("text")).where(F.col("text").isNotNull())
    return page_texts(pages, results), pages.sparkSession.sparkContext.broadcast(lexicon(words))


def line_defects(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(src, row_id, line_no, defect) of running lines, broken words and misread characters.

    Null and empty texts have no lines. The next page is found by an equi-join on (extraction_id,
    page_number), so a document of any number of pages stays spread.
    """
    texts, model = _reader(pages, results)

    def read(batches):
        import pandas as pd

        reader = Reader(model.value)
        for b in batches:
            rows = [(s, r, n, d) for s, r, t, a, p, g, o in zip(b["src"], b["row_id"], b["text"], b["after"], b["pages"], b["seen"], b["own"]) for n, d in reader.defects(t, a, p, frozenset(g), frozenset(o))]
            yield pd.DataFrame(rows, columns=["src", "row_id", "line_no", "defect"]).astype({"row_id": "int64", "line_no": "int32"})

    return texts.mapInPandas(read, "src string, row_id bigint, line_no int, defect string")


def repaired_paragraphs(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(src, row_id, paragraph_no, paragraph): the running paragraphs of every document and image text.

    The pages of an extraction are read on end, in the order of their numbers, up to the next number that is
    missing. A paragraph has the row_id of the page it begins on and is counted from 1 in its document. Rows
    stream past in order; a task holds one document at a time.
    """
    texts, model = _reader(pages, results)
    lone = F.col("doc").isNull() | F.col("page").isNull()
    texts = texts.select("src", "row_id", "text", "pages", "seen", "own", lone.alias("lone"), F.when(lone, F.col("row_id")).otherwise(F.col("doc")).alias("doc"), F.coalesce("page", F.lit(0)).alias("page"))
    ordered = texts.repartition("src", "lone", "doc").sortWithinPartitions("src", "lone", "doc", "page", "row_id")

    def read(batches):
        from itertools import groupby

        import pandas as pd

        reader = Reader(model.value)
        rows = (r for b in batches for r in zip(b["src"], b["lone"], b["doc"], b["page"], b["row_id"], b["text"], b["pages"], b["seen"], b["own"]))
        out = []
        for (src, _, _), held in groupby(rows, key=lambda r: r[:3]):
            runs: list[list] = []
            for r in held:
                if not runs or r[3] - runs[-1][-1][3] > 1:
                    runs.append([])
                runs[-1].append(r)
            found = [(run[k][4], x) for run in runs for k, x in reader.document([r[5] for r in run], bool(run[0][6]), frozenset(run[0][7]), frozenset(run[0][8]))]
            out += [(src, i, k + 1, x) for k, (i, x) in enumerate(found)]
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=["src", "row_id", "paragraph_no", "paragraph"]).astype({"row_id": "int64", "paragraph_no": "int32"})
                out = []
        yield pd.DataFrame(out, columns=["src", "row_id", "paragraph_no", "paragraph"]).astype({"row_id": "int64", "paragraph_no": "int32"})

    return ordered.mapInPandas(read, "src string, row_id bigint, paragraph_no int, paragraph string")
