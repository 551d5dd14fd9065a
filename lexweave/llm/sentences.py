"""Sentence boundaries across languages and scripts.

The boundary rules are compiled into a finite transducer over characters. Its state holds the open quotation and
parenthesis, what the current sentence has shown so far, positions in two tries (abbreviations, words that go on after
one) and a pending boundary with what must follow it. Its outputs say where a boundary is pending, where the next
sentence would start, and whether the pending boundary holds. States and transitions are built when first met and
kept; there are finitely many. Known headings are no part of it: lines are joined with them by their hashes, and the
end of a line that is a heading is a symbol of its own.

Long texts are processed in chunks. A chunk is a function from the state before it to the state after it; chunks are
cut behind or inside words, where everything but the long-range part of the state (quotation, parenthesis, sentence so
far) is the same whatever came before, so the function is a small table. The tables of a text are composed by a
parallel prefix scan, which gives each chunk its true start state; then every chunk emits its boundaries on its own.
"""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this (code points) are processed in chunks of about this size.
CHUNK = 65_536
#: Abbreviations that never end a sentence when a capital follows.
NEVER = (
    "mr mrs ms messrs dr prof st mt gen capt lt sgt rev hon gov sen rep sec secs fig vol pp eq approx ex "  # English
    "bzw vgl ggf inkl zzgl abzgl evtl bspw hrsg dipl resp hr "  # German
    "mme mmes mlle mlles mgr chap éd env hab "  # French
    "sr sra sres srta dra dña tj núm pág págs lic "  # Spanish, Portuguese
    "sig sigg dott avv geom pag pagg "  # Italian
    "dhr mevr mw drs bijv blz excl ca vs "  # Dutch
    "np tzn zob godz ul inż "  # Polish
    "напр стр ул проф гл табл "  # Russian
    "βλ σελ αριθ κεφ"  # Greek
).split()
#: Abbreviations that may end a sentence.
MAY = "etc al co inc ltd corp jr usw ff".split()
#: Abbreviations before a number; in text of capitals only, they never end a sentence.
BEFORE_NUMBER = "all art no nr abs para par ust n".split()
#: Words that go on after such an abbreviation in text of capitals only.
GOES_ON = "subject as under except on in by and or to of must shall may will has is are at for with before after from who if unless not".split()
#: Months that an ordinal number with a full stop precedes.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember".split()
#: Opening quotation marks with what closes them.
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"'}

_CLOSERS = list(QUOTES)
_SCRIPTS = (
    ("thai", regex.compile(r"[\p{Thai}]")),
    ("cjk", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー々]")),
    ("greek", regex.compile(r"\p{Greek}")),
)
_LETTER, _MARK, _DIGIT, _SPACE = (regex.compile(p) for p in (r"\p{L}", r"\p{M}", r"\p{N}", r"[\s\p{Z}​﻿]"))
_UNSEEN = "\0"  # stands for any letter that no trie has

# q: index of the opening mark + 1; qc: a colon came before it; qs: it opened the sentence; qi: an end mark is last in it.
# p: parentheses; lower, seen, thai: of the sentence; w: abbreviation trie node, -1 none; pm: "p." or "a." came directly
# before; prev: kind of the last character; h: lines since the sentence began with a line, 0 if it did not; t, ph, k: pending boundary, phase, detail.
State = namedtuple("State", "q qc qs qi p lower seen thai w one pm prev colon nl h t ph k")
START = State(0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, "start", 0, 1, 1, "", 0, 0)
#: Line ends.
NEWLINES = "\n\u2028\u2029\x0b\x0c\x85"
#: Lines that a heading may be wrapped into.
WRAPPED = 4
#: What stands for a line end, by the set of n for which the n lines before it are a heading (no text has a lone surrogate).
HEADING_ENDS = [chr(0xD800 + i) for i in range(2**WRAPPED)]
#: Bits of a symbol's number in a transition's key: more than there are code points.
SYMBOL_BITS = 21
#: States and words whose transitions a worker remembers, and the pieces that a text is read in: words of scripts that
#: part them by blanks, single characters otherwise.
REMEMBERED = 500_000
_PIECE = re.compile(r"[A-Za-zÀ-ɏΆ-ώЀ-ӿא-תء-يऄ-हा-्]{2,24}|[\s\S]")
CAND, EXTEND, NEXT, CUT, DROP = range(1, 6)


class _Trie:
    def __init__(self, words: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.final: dict[int, str] = {}
        for word in words:
            node = 0
            for c in word:
                nxt = self.next[node].get(c)
                if nxt is None:
                    self.next.append({})
                    nxt = self.next[node][c] = len(self.next) - 1
                node = nxt
            self.final[node] = word

    def step(self, node: int, c: str) -> int:
        return self.next[node].get(c, -1) if node >= 0 else -1


class SentenceTransducer:
    def __init__(self) -> None:
        self.abbreviations = _Trie([*NEVER, *MAY, *BEFORE_NUMBER])
        self.go_on, self.months = _Trie(GOES_ON), _Trie(MONTHS)
        self.letters = {c for t in (self.abbreviations, self.go_on, self.months) for n in t.next for c in n}
        self.symbols: dict[str, int] = {}
        self.symbol_list: list[tuple] = []
        self.by_symbol: dict[tuple, int] = {}
        self.states: dict[State, int] = {}
        self.state_list: list[State] = []
        self.table: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.pieces: dict[tuple[int, str], tuple[int, tuple[tuple[int, int], ...]]] = {}
        self.start = self.state_id(START)
        self.carried = [
            State(q, qc, qs, 0, p, lower, seen, thai, -1, 0, 0, "", 0, 0, h, "", 0, 0)
            for (q, qc, qs), p, lower, seen, thai, h in product(
                [(0, 0, 0), *product(range(1, len(_CLOSERS) + 1), (0, 1), (0, 1))], range(3), (0, 1), (0, 1), (0, 1), range(WRAPPED + 1)
            )
        ]
        self.carried_id = {s: i for i, s in enumerate(self.carried)}

    def state_id(self, s: State) -> int:
        i = self.states.get(s)
        if i is None:
            i = self.states[s] = len(self.state_list)
            self.state_list.append(s)
        return i

    def symbol_id(self, c: str) -> int:
        sym = self._classify(c)
        i = self.by_symbol.get(sym)
        if i is None:
            i = self.by_symbol[sym] = len(self.symbol_list)
            self.symbol_list.append(sym)
        self.symbols[c] = i
        return i

    def _classify(self, c: str) -> tuple[str, str, str]:
        """(kind, letter of the tries, detail)."""
        if c in "\r​‌‍﻿­":
            return "none", "", ""
        if c in NEWLINES or c in HEADING_ENDS:
            return "nl", " ", "" if c in NEWLINES else str(HEADING_ENDS.index(c))
        if c in QUOTES or c in "”»」』":
            return "quote", c, c
        folded = c.casefold()
        known = folded if folded in self.letters else _UNSEEN
        for kinds, kind in (("([（［【", "open"), (")]）］】", "close"), (".", "dot"), ("!?؟…‼⁇⁈⁉", "hard"), ("。！？｡", "cjkend"), ("।॥", "danda"), (";;", "semi"), (":：", "colon"), ("¿¡", "begin")):
            if c in kinds:
                return kind, known, "bracket" if c in "[［【]］】" else ""
        if _MARK.match(c):
            return "mark", known, ""
        if _LETTER.match(c):
            script = next((n for n, r in _SCRIPTS if r.match(c)), "")
            case = "upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "caseless"
            return "letter", known, script + "/" + case
        if _DIGIT.match(c):
            return "digit", known, ""
        if _SPACE.match(c):
            return "blank", " ", ""
        return "other", known, c if c in "-–—§№&" else ""

    # One step ----------------------------------------------------------------------------------------------------

    def _step(self, s: State, sym: tuple[str, str, str]) -> tuple[State, tuple[int, ...]]:
        kind, c, detail = sym
        if kind == "none" or kind == "mark":
            return s, ()
        events: list[int] = []
        if s.t:
            s, done = self._pending(s, kind, c, detail, events)
            if done:
                return s, tuple(events)
        s = self._plain(s, kind, c, detail, events)
        return s, tuple(events)

    def _fresh(self, s: State, newline: int) -> State:
        """The state at the first character of a new sentence."""
        return START._replace(nl=newline, h=newline)

    def _cut(self, s: State, events: list[int]) -> State:
        events.append(CUT)
        return self._fresh(s, s.nl)

    def _drop(self, s: State, events: list[int]) -> State:
        events.append(DROP)
        return s._replace(t="", ph=0, k=0)

    def _pending(self, s: State, kind: str, c: str, detail: str, events: list[int]) -> tuple[State, bool]:
        """Whether the pending boundary holds, seeing one more character; True if that character is used up."""
        t = s.t
        if s.ph == 2:  # in a parenthesis that may be a label
            if kind == "close" and 1 <= s.k <= 4:
                s = self._cut(s, events)
                return s._replace(prev="close", w=-1, h=0), True
            if kind in ("letter", "digit") and s.k < 4:
                return s._replace(k=s.k + 1), True
            inside = 1
            if t in ("dot", "hard", "cjkend", "danda"):
                s = self._cut(s, events)
            else:
                s = self._drop(s, events)
            return s._replace(p=inside, w=-1, h=0, prev="other"), False
        if s.ph == 3:  # in a word that may show that the sentence goes on
            trie = self.months if t == "num" else self.go_on
            if kind == "letter":
                node = trie.step(s.k, c)
                if node >= 0:
                    return s._replace(k=node), True
            elif s.k in trie.final:
                return self._drop(s, events)._replace(w=-1, prev="letter", seen=1), False
            s = self._cut(s, events)
            return s._replace(seen=1, w=-1, h=0, prev="letter"), False
        if kind == "blank" or kind == "nl":
            if t == "para" and kind == "nl":
                return s._replace(t="para2", ph=1, nl=1), True
            return s._replace(ph=1, nl=s.nl | (kind == "nl"), prev=kind), True
        if s.ph == 0 and t != "para":
            if kind in ("dot", "hard", "cjkend", "danda"):
                events.append(CAND if t == "quote" else EXTEND)
                return s._replace(t="dot" if kind == "dot" and t in ("quote", "num") else "hard" if kind == "hard" else t), True
            if kind == "close" and s.p == 0 or kind == "quote" and c in "”»」』":
                events.append(EXTEND)
                return s, True
        # a character that could start the next sentence
        if t == "para":
            return self._drop(s, events), False
        if kind == "open" and detail != "bracket":
            events.append(NEXT)
            return s._replace(ph=2, k=0), True
        if kind == "letter":
            script, case = detail.split("/")
            if t == "head":
                holds = True
            elif t == "thai":
                holds = script == "thai" or case == "upper"
            elif t == "para2":
                holds = case != "lower"
            elif case == "caseless":
                holds = t != "quote" or s.qc == 1
            elif case == "upper":
                holds = not (t == "quote" and not s.lower and s.qs)
                if s.ph == 0 and t == "dot" and s.prev not in ("letter", "digit", "close", "quote", "end"):
                    holds = False
                if holds and (t == "num" and s.ph == 1 or t == "may" and not s.lower):
                    trie = self.months if t == "num" else self.go_on
                    node = trie.step(0, c)
                    if node >= 0:
                        events.append(NEXT)
                        return s._replace(ph=3, k=node), True
            else:
                holds = t == "cjkend" or t == "danda"
        elif kind == "digit":
            holds = t in ("hard", "cjkend", "danda", "head")
        elif kind == "begin" or kind == "quote" and c in QUOTES:
            holds = t not in ("thai",)
        elif kind == "other" and detail in ("§", "№"):
            holds = t in ("hard", "cjkend", "danda", "head")
        elif kind == "open":
            holds = t in ("hard", "cjkend", "danda", "head", "dot", "num")
        else:
            holds = t in ("cjkend", "danda", "head")
        if not holds:
            return self._drop(s, events), False
        events.append(NEXT)
        return self._cut(s, events), False

    def _plain(self, s: State, kind: str, c: str, detail: str, events: list[int]) -> State:
        free = not s.q and not s.p
        if kind == "letter":
            script, case = detail.split("/")
            boundary = s.prev not in ("letter", "digit", "hyphen", "close", "sign")
            w = self.abbreviations.step(0, c) if boundary else self.abbreviations.step(s.w, c)
            one = (2 if c in "pa" else 3 if c == "m" and s.pm else 1) if boundary and script not in ("cjk", "thai") else 0
            return s._replace(
                qi=0, lower=s.lower | (case == "lower"), seen=s.seen | (s.p == 0), thai=int(script == "thai") if not s.p else s.thai, w=w, one=one,
                pm=s.pm if boundary else 0, prev="letter", colon=0, nl=0, k=int(script == "greek"),
            )
        base = s._replace(w=-1, one=0, pm=0, nl=0, k=0)
        if kind == "digit":
            return base._replace(qi=0, prev="digit", colon=0)
        if kind == "blank" or kind == "nl":
            base = base._replace(prev=kind, colon=s.colon, nl=s.nl if kind == "blank" else 1)
            if kind == "nl":
                if s.seen and s.h:
                    base = base._replace(h=(s.h + 1) % (WRAPPED + 1))
                if s.prev == "nl":
                    base = base._replace(q=0, qc=0, qs=0, qi=0, p=0)
                if s.seen and free:
                    if s.h and detail and int(detail) >> s.h - 1 & 1:
                        events.append(CAND)
                        return base._replace(t="head", ph=1)
                    if s.thai:
                        events.append(CAND)
                        return base._replace(t="thai", ph=1)
                    events.append(CAND)
                    return base._replace(t="para", ph=0)
            elif s.thai and s.seen and free and s.prev in ("letter", "digit", "close", "quote", "other"):
                events.append(CAND)
                return base._replace(t="thai", ph=1)
            return base
        if kind == "open":
            return base._replace(p=min(2, s.p + 1), prev="open", qi=0)
        if kind == "close":
            return base._replace(p=max(0, s.p - 1), prev="close")
        if kind == "colon":
            return base._replace(prev="other", colon=1, qi=0)
        if kind == "quote":
            if s.q:
                if c in QUOTES[_CLOSERS[s.q - 1]]:
                    ended, at_start, colon = s.qi, s.qs, s.qc
                    base = base._replace(q=0, qc=0, qs=0, qi=0, prev="quote", colon=0)
                    if ended and not s.p:
                        events.append(CAND)
                        return base._replace(t="quote", ph=0, qc=colon, qs=at_start)
                return base._replace(prev="quote")
            if c in QUOTES:
                return base._replace(q=_CLOSERS.index(c) + 1, qc=s.colon, qs=int(not s.seen), qi=0, prev="open", colon=0)
            return base._replace(prev="quote")
        if kind in ("dot", "hard", "cjkend", "danda", "semi"):
            if kind == "semi" and not (s.prev == "letter" and s.k == 1):
                return base._replace(prev="other", qi=0)
            kind = "hard" if kind == "semi" else kind
            if s.q:
                return base._replace(qi=1, prev="end")
            if s.p:
                return base._replace(prev="end")
            if kind == "dot":
                word = self.abbreviations.final.get(s.w) if s.w > 0 and s.prev == "letter" else None
                if s.one == 3:
                    kind = "may"
                elif s.one:
                    return base._replace(prev="dot", pm=int(s.one == 2))
                elif word in NEVER or word in BEFORE_NUMBER and not s.lower:
                    return base._replace(prev="dot")
                elif word in MAY:
                    kind = "may"
                elif s.prev == "digit":
                    kind = "num"
            events.append(CAND)
            return base._replace(t=kind, ph=0, prev=s.prev if s.prev in ("letter", "digit", "close", "quote") else "end")
        return base._replace(prev="hyphen" if detail in ("-", "–") else "sign" if detail == "§" else "other", colon=0, qi=0)

    # Running -----------------------------------------------------------------------------------------------------

    def _move(self, key: int, state: int, symbol: int) -> tuple[int, tuple[int, ...]]:
        new, events = self._step(self.state_list[state], self.symbol_list[symbol])
        out = self.table[key] = self.state_id(new), events
        return out

    def run(self, text: str, state: int, at: int = 0) -> tuple[int, list[tuple[int, int]]]:
        """The state after text, and the events with the positions where they happened.

        What a whole word does to a state is remembered, so a word that was met before is one step.
        """
        events: list[tuple[int, int]] = []
        pieces = self.pieces
        for piece in _PIECE.findall(text):
            got = pieces.get((state, piece))
            if got is None:
                got = self._piece(state, piece)
            state, seen = got
            if seen:
                events.extend((at + i, e) for i, e in seen)
            at += len(piece)
        return state, events

    def _piece(self, state: int, piece: str) -> tuple[int, tuple[tuple[int, int], ...]]:
        start, events = state, []
        for i, c in enumerate(piece):
            y = self.symbols.get(c)
            if y is None:
                y = self.symbol_id(c)
            key = state << SYMBOL_BITS | y
            state, seen = self.table.get(key) or self._move(key, state, y)
            events += [(i, e) for e in seen]
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        out = self.pieces[start, piece] = state, tuple(events)
        return out

    def domain(self, seen: str) -> list[int]:
        """The carried states that are possible after a text in which only these opening marks were seen.

        Lines since the sentence began matter only in texts with headings, which have a line end among the marks.
        """
        marks, deepest = {0, *(_CLOSERS.index(c) + 1 for c in seen if c in QUOTES)}, 2 if any(c in OPENING for c in seen) else 0
        return [i for i, s in enumerate(self.carried) if s.q in marks and s.p <= deepest and ("\n" in seen or not s.h)]

    def function(self, text: str, before: str, seen: str) -> np.ndarray:
        """For each carried state that is possible before text (see domain) the one after it; -1 for the others.

        text must end where chunk_ends may cut; before: the character before it.
        """
        live: dict[int, list[int]] = {}
        for i in self.domain(seen):
            live.setdefault(self.resume(i, before), []).append(i)
        for at, c in enumerate(text):
            if len(live) == 1:  # all starts have met
                ((state, starts),) = live.items()
                live = {self.run(text[at:], state)[0]: starts}
                break
            y = self.symbols.get(c)
            if y is None:
                y = self.symbol_id(c)
            new: dict[int, list[int]] = {}
            for state, starts in live.items():
                key = state << SYMBOL_BITS | y
                got = self.table.get(key) or self._move(key, state, y)
                if got[0] in new:
                    new[got[0]] += starts
                else:
                    new[got[0]] = starts
            live = new
        out = np.full(len(self.carried), -1, dtype=np.int32)
        for state, starts in live.items():
            out[starts] = self.carry(state, "\n" in seen)
        return out

    def carry(self, state: int, headings: bool) -> int:
        """The carried part of a state, as its index; headings: whether the text has any (see domain)."""
        s = self.state_list[state]
        return self.carried_id[State(s.q, s.qc if s.q else 0, s.qs if s.q else 0, 0, s.p, s.lower, s.seen, s.thai, -1, 0, 0, "", 0, 0, s.h if headings else 0, "", 0, 0)]

    def resume(self, carried: int, before: str) -> int:
        """The state in which a chunk starts that was cut behind this character, a blank or a letter with its marks."""
        if before == " ":
            return self.state_id(self.carried[carried]._replace(prev="blank"))
        return self.state_id(self.carried[carried]._replace(prev="letter", k=int(bool(_SCRIPTS[2][1].match(before)))))


#: Opening brackets.
OPENING = "([（［【"
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Hangul}]"
#: A word's end and a blank, or the inside of a word that no trie goes on in and that no label can be.
_CUT_HERE = regex.compile(rf"(?!\p{{Thai}})\p{{L}}\p{{M}}*+ |(?:{_UNSPACED}\p{{M}}*+){{5}}|(?:(?!{_UNSPACED})\p{{L}}){{16}}(?!\p{{M}})")
_NEWLINE = regex.compile(f"[{NEWLINES}]")
_LAST_LETTER = regex.compile(r"(?r)\p{L}| ")


def chunk_ends(text: str, size: int) -> list[int]:
    """Where text may be cut: about every size code points, at the first place that fits (see _CUT_HERE)."""
    ends, at = [], size
    while at < len(text) and (m := _CUT_HERE.search(text, at)) and m.end() < len(text):
        ends.append(m.end())
        at = m.end() + size
    return [*ends, len(text)]


def chunks(text: str, lines: Collection[int], size: int) -> Iterator[tuple[int, str, str, str]]:
    """(start, part, last letter or blank before it, marks) of every chunk.

    marks: the opening marks before it that may still be open, and a line end if the text has headings.

    lines: see mark_headings; the ends of headings are marked in the parts.
    """
    marked, start, headings = mark_headings(text, lines), 0, "\n" if len(lines) else ""
    for end in chunk_ends(text, size):
        blank_line = max(0, text.rfind("\n\n", 0, start))
        seen = "".join(c for c in (*QUOTES, *OPENING) if text.find(c, blank_line, start) >= 0)
        yield start, marked[start:end], _LAST_LETTER.search(text, 0, start)[0] if start else "", seen + headings
        start = end


def mark_headings(text: str, lines: Iterable[int]) -> str:
    """text with one of HEADING_ENDS for the line ends of headings; lengths and places stay.

    lines: WRAPPED * i + n - 1 for each n lines that are a heading together, of which the last is line i, from 0.
    """
    wanted: dict[int, int] = {}
    for x in lines:
        wanted[x // WRAPPED] = wanted.get(x // WRAPPED, 0) | 1 << x % WRAPPED
    if not wanted:
        return text
    out = list(text)
    for i, m in enumerate(_NEWLINE.finditer(text)):
        if i in wanted:
            out[m.start()] = HEADING_ENDS[wanted[i]]
    return "".join(out)


def compose(functions: list[np.ndarray]) -> list[np.ndarray]:
    """Inclusive prefix compositions of state-transition functions, by recursive doubling (Hillis-Steele scan)."""
    scan, step = list(functions), 1
    while step < len(scan):
        scan = [scan[i] if i < step else scan[i][scan[i - step]] for i in range(len(scan))]
        step *= 2
    return scan


def sentences_from_events(events: Iterable[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence; offsets in code points, end exclusive, no white space around."""
    out, start, cand, nxt = [], 0, -1, -1
    for at, e in events:
        if e == CAND:
            nxt = -1
            cand = at if _SPACE.match(text[at]) else at + 1
        elif e == EXTEND:
            cand = at + 1
        elif e == NEXT:
            nxt = at
        elif e == CUT and cand > start:
            out.append((start, cand))
            start, cand = nxt, -1
    out.append((start, len(text)))
    trimmed = []
    for a, b in out:
        while a < b and _SPACE.match(text[a]):
            a += 1
        while b > a and _SPACE.match(text[b - 1]):
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


@lru_cache(maxsize=1)
def transducer() -> SentenceTransducer:
    return SentenceTransducer()


def split_sentences(text: str | None, lines: Collection[int] = (), chunk: int = CHUNK) -> list[tuple[int, int]]:
    """The sentences of one text, chunk by chunk if it is long; null and empty texts have none.

    lines: the headings among its lines, see mark_headings.
    """
    if not text:
        return []
    machine = transducer()
    if len(text) <= chunk:
        return sentences_from_events(machine.run(mark_headings(text, lines), machine.start)[1], text)
    parts = list(chunks(text, lines, chunk))
    first = machine.carry(machine.run(parts[0][1], machine.start)[0], len(lines) > 0) if len(parts) > 1 else 0
    tables = compose([machine.function(part, before, seen) for _, part, before, seen in parts[1:-1]])
    carried = [first, *(int(t[first]) for t in tables)]
    events: list[tuple[int, int]] = []
    for i, (start, part, before, _) in enumerate(parts):
        events += machine.run(part, machine.resume(carried[i - 1], before) if i else machine.start, start)[1]
    return sentences_from_events(events, text)


#: Parts that every heading is copied to, so that a frequent line meets it in as many tasks.
SALTS = 8


def _plain(line: Column) -> Column:
    """A line in lower case, without invisible characters, with one blank for each run of blanks."""
    s = F.regexp_replace(F.lower(line), r"[\x{00AD}\x{200B}-\x{200D}\x{FEFF}\r]+", "")
    return F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " "))


def _hashes(plain: Column) -> Column:
    """Two hashes of a plain line, blanks and full stops at its end aside; null if nothing is left."""
    s = F.rtrim(plain, F.lit(" ."))
    return F.transform(F.array(s), lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))))[0]


def heading_lines(df: DataFrame, key: str, text: str, headings: DataFrame, column: str) -> DataFrame:
    """(key, lines): where one to WRAPPED lines of a text are one of the headings (see mark_headings); only texts that have any.

    All headings count, in any number and length. Lines meet them by two 64-bit hashes.
    """
    nl = f"[{NEWLINES}]"
    listed = df.filter(F.col(text).rlike(nl)).select(key, F.transform(F.split(F.col(text), nl), _plain).alias("_all"))
    listed = listed.select(key, "_all", F.posexplode("_all").alias("_line", "_first")).filter("_first <> ''")
    spans = F.transform(F.sequence(F.lit(1), F.lit(WRAPPED)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_all", F.col("_line") + 1, n), " ").alias("said")))
    listed = listed.select(key, "_line", F.explode(spans).alias("s"))
    place = (F.col("_line") + F.col("s.n") - 1) * WRAPPED + F.col("s.n") - 1
    listed = listed.select(key, place.cast("int").alias("_place"), _hashes(F.col("s.said")).alias("_h")).filter("_h IS NOT NULL")
    listed = listed.withColumn("_salt", F.pmod(F.xxhash64(key, "_place"), F.lit(SALTS)).cast("int"))
    known = headings.select(_hashes(_plain(F.col(column))).alias("_h")).filter("_h IS NOT NULL").distinct()
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return listed.join(known, ["_h", "_salt"], "left_semi").groupBy(key).agg(F.collect_list("_place").alias("lines"))


def sentence_rows(
    df: DataFrame, key: str, text: str, headings: DataFrame | None = None, column: str = "heading", chunk: int = CHUNK, only: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """One row per sentence: (key, sent_idx from 0, sent_start, sent_end, sent_text).

    key must be unique. Null, empty and blank texts give no row; other columns of df are left out. headings: a table
    whose column holds lines that are units although they have no end mark. A text of one chunk is split where it is;
    the chunks of a longer one are rows of their own: their functions are computed in parallel over the cluster, only
    the tables (a few kB a chunk) of one text meet in one task for the scan, then all chunks emit their events in
    parallel, and only these and the text, which was one row before, meet again. only: picks rows by key and text
    (in column _text); it sees every text once.
    """
    texts = df.select(key, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    lines = heading_lines(texts, key, "_text", headings, column) if headings is not None else None

    def marked_texts(texts: DataFrame) -> DataFrame:
        picked = only(texts)
        return picked.withColumn("lines", F.array().cast("array<int>")) if lines is None else picked.join(lines, key, "left")

    kind = f"`{key}` {df.schema[key].dataType.simpleString()}"
    result = f"{kind}, sent_idx int, sent_start int, sent_end int, sent_text string"

    def sentences(keys: list, texts: list[str], places: list[list[tuple[int, int]]]) -> pd.DataFrame:
        rows = [(k, j, a, b, t[a:b]) for k, t, found in zip(keys, texts, places) for j, (a, b) in enumerate(found)]
        return pd.DataFrame(rows, columns=[key, "sent_idx", "sent_start", "sent_end", "sent_text"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [split_sentences(t, () if n is None else n, len(t)) for t, n in zip(p["_text"], p["lines"])]
            yield sentences(list(p[key]), list(p["_text"]), found)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for k, t, n in zip(p[key], p["_text"], p["lines"]):
                for i, (start, part, before, seen) in enumerate(chunks(t, () if n is None else n, chunk)):
                    ends = [(j << WRAPPED) + HEADING_ENDS.index(part[j]) for j in range(len(part)) if "\ud800" <= part[j] < "\ud900"]
                    yield pd.DataFrame({key: [k], "chunk": [i], "start": [start], "part": [t[start : start + len(part)]], "ends": [ends], "before": [before], "seen": [seen]})

    def marked(part: str, ends: Iterable[int]) -> str:
        out = list(part)
        for x in ends:
            out[x >> WRAPPED] = HEADING_ENDS[x % 2**WRAPPED]
        return "".join(out)

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer()
        for p in batches:
            tables = []
            for i, part, ends, before, seen in zip(p["chunk"], p["part"], p["ends"], p["before"], p["seen"]):
                t = marked(part, ends)
                tables.append((np.full(len(machine.carried), machine.carry(machine.run(t, machine.start)[0], "\n" in seen), dtype=np.int32) if i == 0 else machine.function(t, before, seen)).tobytes())
            yield pd.DataFrame({key: p[key], "chunk": p["chunk"], "f": tables})

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        tables = compose([np.frombuffer(f, dtype=np.int32) for f in group["f"]])
        return pd.DataFrame({key: group[key], "chunk": group["chunk"], "state": [-1, *(int(t[0]) for t in tables[:-1])]})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer()
        for p in batches:
            for k, i, a, part, ends, before, carried in zip(p[key], p["chunk"], p["start"], p["part"], p["ends"], p["before"], p["state"]):
                state = machine.start if carried < 0 else machine.resume(int(carried), before)
                events = machine.run(marked(part, ends), state, a)[1]
                yield pd.DataFrame({key: [k], "chunk": [i], "part": [part], "at": [[x for x, _ in events]], "event": [[e for _, e in events]]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        t = "".join(group["part"])
        events = ((int(x), int(e)) for at, event in zip(group["at"], group["event"]) for x, e in zip(at, event))
        return sentences([group[key].iloc[0]], [t], [sentences_from_events(events, t)])

    short = marked_texts(texts.filter(F.length("_text") <= chunk)).mapInPandas(split, result)
    parts = marked_texts(texts.filter(F.length("_text") > chunk)).mapInPandas(cut, f"{kind}, chunk int, start int, part string, ends array<int>, before string, seen string")
    parts = parts.repartition(key, "chunk")
    states = parts.mapInPandas(functions, f"{kind}, chunk int, f binary").groupBy(key).applyInPandas(scan, f"{kind}, chunk int, state int")
    events = parts.join(states, [key, "chunk"]).mapInPandas(emit, f"{kind}, chunk int, part string, at array<int>, event array<int>")
    return short.unionByName(events.groupBy(key).applyInPandas(join, result))
