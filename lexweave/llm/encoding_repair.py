"""Garbled text from wrong character encodings.

For every listed pair (true encoding, wrong encoding) the garbled form of what clean text contains is computed beforehand: of
single characters where the true encoding is UTF-8, of three-character sequences where it is a legacy code page, whose
single characters would prove nothing, or where the wrong encoding is multi-byte or Thai. All forms go into one multi-pattern automaton (Aho-Corasick). A row is damaged
if the automaton finds a strong form, or several weak ones. Only matched spans are decoded again; correct text around
them stays untouched. Repair is repeated, so text that was decoded wrongly twice is restored too.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings that UTF-8 text is taken for.
UTF8_TAKEN_FOR = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-15", "cp1254", "cp1253", "cp1256", "cp1257")
#: The same, where the form of one character might be a word, so forms of sequences are taken.
UTF8_TAKEN_FOR_WORDS = ("cp874", "gb18030", "cp950", "cp932")
MULTIBYTE = {"gb18030", "cp950", "cp932"}
#: Fixed values: (legacy encoding, encodings that its text is taken for).
LEGACY_TAKEN_FOR = (
    ("cp1252", ("mac_roman", "cp437", "cp850", "cp1250", "cp1251")),
    ("mac_roman", ("cp1252", "latin-1")),
    ("cp437", ("cp1252", "latin-1")),
    ("cp850", ("cp1252", "latin-1")),
    ("cp1250", ("cp1252", "latin-1")),
    ("iso8859-2", ("cp1252", "latin-1")),
    ("cp1251", ("cp1252", "latin-1", "mac_roman", "koi8-r", "cp866")),
    ("koi8-r", ("cp1252", "latin-1", "cp1251")),
    ("cp866", ("cp1252", "latin-1", "cp1251")),
    ("cp1253", ("cp1252", "latin-1")),
    ("iso8859-7", ("cp1252", "latin-1")),
    ("cp1256", ("cp1252", "latin-1")),
    ("iso8859-6", ("cp1252", "latin-1")),
    ("cp874", ("cp1252", "latin-1")),
    ("shift_jis", ("cp1252", "latin-1", "mac_roman")),
    ("euc_jp", ("cp1252", "latin-1")),
    ("gbk", ("cp1252", "latin-1")),
    ("big5", ("cp1252", "latin-1")),
)
#: Code point ranges of the characters whose UTF-8 form may be garbled, besides those of clean text.
REPERTOIRE = ((0xA0, 0x17F), (0x218, 0x21B), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x60C, 0x66C), (0x900, 0x96F), (0xE01, 0xE5B), (0x1F00, 0x1FFC), (0x2009, 0x206F), (0x20A0, 0x20BF), (0x2116, 0x2122), (0x2190, 0x2199), (0x2264, 0x2265), (0x2600, 0x27BF), (0xFE0E, 0xFE0F), (0x3000, 0x30FF), (0xFF01, 0xFF9F), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF))
REPLACEMENT = "�"
_DIGITS = str.maketrans("123456789", "000000000")
_LETTERS = regex.compile(r"\p{L}+")
_SAID = regex.compile(r"\S+")
#: Legacy pairs that are tried on the words of a text, those that explain most of it.
LIKELY = 4


@lru_cache(maxsize=None)
def _bytes_to_chars(encoding: str) -> tuple[str, ...]:
    """What each byte becomes when read in a single-byte encoding; undefined bytes become C1 controls, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _chars_to_bytes(encoding: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_bytes_to_chars(encoding))}


def garble(text: str, true: str, wrong: str) -> str | None:
    """text as it looks when its bytes in the true encoding are read in the wrong one; None if it has no such bytes."""
    try:
        raw = text.encode(true)
    except UnicodeEncodeError:
        return None
    if wrong in MULTIBYTE:
        for n in range(len(raw), len(raw) - 4, -1):  # the last character may need bytes of what follows
            try:
                return raw[:n].decode(wrong)
            except UnicodeDecodeError:
                pass
        return None
    table = _bytes_to_chars(wrong)
    return "".join(table[b] for b in raw)


def ungarble(text: str, true: str, wrong: str) -> str | None:
    """The reverse of garble; None if text is no such result."""
    if wrong in MULTIBYTE:
        try:
            return text.encode(wrong).decode(true)
        except UnicodeError:
            return None
    table = _chars_to_bytes(wrong)
    try:
        return bytes(table[c] for c in text).decode(true)
    except (KeyError, UnicodeDecodeError):
        return None


def clean_sequences(clean: DataFrame, text: str) -> list[str]:
    """All three-character sequences with a non-ASCII character, the most frequent ones first, digits written as 0.

    Counted over all rows where they are; the driver gets each of them once. Their number grows with the letters in
    use, far slower than the text.
    """
    pattern = F.lit(r"(?s)(?=((?=.{0,2}[^\x00-\x7F]).{3}))")
    found = F.explode(F.regexp_extract_all(F.translate(F.col(text), "123456789", "000000000"), pattern, F.lit(1)))
    counted = clean.select(found.alias("s")).groupBy("s").count()
    return [r["s"] for r in counted.orderBy(F.desc("count"), "s").collect()]


class GarbleDetector:
    """The automaton of all garbled forms, made from sequences of clean text."""

    def __init__(self, sequences: tuple[str, ...]) -> None:
        clean = self.clean = set(sequences)
        pairs = {s[i : i + 2] for s in sequences for i in (0, 1)}
        alphabet = {c for s in sequences for c in s if c > "\x7f" and c != REPLACEMENT}
        alphabet |= {chr(c) for a, b in REPERTOIRE for c in range(a, b + 1)}
        twice = {c for e in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251") for c in _bytes_to_chars(e) if c > "\x7f"}
        alphabet |= twice - {"\x85"}  # what text that was garbled before consists of
        forms: dict[str, set[tuple[str, str]]] = {}
        signs: dict[str, int] = {}  # of forms with a letter for a sign: where it is

        def usual(s: str) -> bool:
            return s in pairs if len(s) == 2 else all(s[i : i + 3] in clean for i in range(len(s) - 2))

        def add(s: str | None, true: str, wrong: str) -> None:
            if s and true == "utf-8" and len(s) > 2 and s.islower() and _LETTERS.fullmatch(s):
                return  # small letters only, as in Russian "ред", which a danda read as cp866 is
            if s and len(s) > 1 and not s.isascii() and (s in forms or not usual(s)):
                forms.setdefault(s, set()).add((true, wrong))

        for wrong in UTF8_TAKEN_FOR:
            for c in alphabet:
                add(garble(c, "utf-8", wrong), "utf-8", wrong)
        for wrong in UTF8_TAKEN_FOR_WORDS:
            for s in sequences:
                g = garble(s, "utf-8", wrong)
                if g and len(g) > 2 and (wrong != "cp874" or len(g) > 5 or any(c > "\x7f" and unicodedata.category(c)[0] not in "LM" for c in g)):
                    add(g, "utf-8", wrong)
        for true, wrongs in LEGACY_TAKEN_FOR:
            for wrong in wrongs:
                for s in sequences:
                    g = garble(s, true, wrong)
                    if g != s:
                        add(g, true, wrong)
                        if g in forms and len(g) == len(s) and (at := self._sign_as_letter(s, g, pairs)) is not None:
                            signs[g] = at
        self.automaton = ahocorasick.Automaton()
        for s, how in forms.items():
            self.automaton.add_word(s, (len(s), self._weight(s, how), tuple(sorted(how, key=lambda p: (p[0] != "utf-8", p))), signs.get(s)))
        for c in [REPLACEMENT, *(chr(b) for b in range(0x80, 0xA0) if b != 0x85)]:
            self.automaton.add_word(c, (1, 2, (), None))
        self.automaton.make_automaton()

    @staticmethod
    def _sign_as_letter(s: str, g: str, pairs: set[str]) -> int | None:
        """Where a sign of s became a letter of g that touches a digit as no letter of clean text does."""
        for i, (a, b) in enumerate(zip(s, g)):
            if a > "\x7f" and unicodedata.category(a)[0] in "SP" and b > "\x7f" and b.isalpha():
                touching = {g[j : j + 2] for j in (i - 1, i) if "0" in g[max(j, 0) : j + 2]}
                if touching and not touching & pairs:
                    return i
        return None

    @staticmethod
    def _weight(s: str, how: set[tuple[str, str]]) -> int:
        """2: a strong form, enough alone. 1: letters only, which might be a rare word."""
        if all(true != "utf-8" for true, _ in how):
            # of a legacy form: a symbol between letters, or a capital after a small letter, is no accident
            inner = any(not a.isspace() and not b.isspace() and (a.islower() and b.isupper() and b > "\x7f") for a, b in zip(s, s[1:]))
            return 2 if inner or (len(s) >= 5) else 1
        return 1 if _LETTERS.fullmatch(s) and len(s) == 2 else 2

    def matches(self, text: str) -> list[tuple[int, int, int, tuple]]:
        """(start, end, weight, encoding pairs) of every garbled form in text.

        A letter for a sign is strong where it touches no other letter; within a word it might be one of a lost blank.
        """
        out = []
        for end, (n, w, how, sign) in self.automaton.iter(text.translate(_DIGITS)):
            start = end + 1 - n
            if w == 1 and sign is not None:
                at = start + sign
                w = 1 if text[max(at - 1, 0) : at].isalpha() or text[at + 1 : at + 2].isalpha() else 2
            out.append((start, end + 1, w, how))
        return out

    def is_garbled(self, *texts: str | None) -> bool:
        """Whether a strong form occurs in one of the texts, which belong to one record, or several weak ones in all of them."""
        weak = 0
        for text in dict.fromkeys(texts):  # a text that repeats proves nothing more
            if not text or text.isascii():
                continue
            places: set[int] = set()
            for start, _, w, _ in self.matches(text):
                if w > 1 or (start and text[start - 1].islower() and text[start].isupper()):
                    return True  # strong, or a capital inside a word
                places.add(start)
                if weak + len(places) > 1:
                    return True
            weak += len(places)
        return False

    def _spans(self, text: str, utf8: bool) -> list[tuple[int, int, dict]]:
        """Runs of touching forms of UTF-8, or of legacy encodings, with the pairs that explain them by characters explained."""
        spans: list[list] = []
        for start, end, _, how in sorted(self.matches(text), key=lambda m: m[:2]):
            pairs = [p for p in how if (p[0] == "utf-8") == utf8]
            if not pairs:
                continue
            if not spans or start > spans[-1][1]:
                spans.append([start, end, {}])
            spans[-1][1] = max(end, spans[-1][1])
            for pair in pairs:
                spans[-1][2][pair] = spans[-1][2].get(pair, 0) + end - start
        return [tuple(s) for s in spans]

    @staticmethod
    def _extended(text: str, start: int, end: int, floor: int, wrong: str) -> tuple[int, int]:
        """A span of UTF-8 forms with the whole UTF-8 sequences that touch it, of characters that no form is known of."""
        table = _chars_to_bytes(wrong)

        def whole(at: int, n: int) -> bool:
            raw = [table.get(c, 0) for c in text[at : at + n]]
            size = 2 if 0xC2 <= raw[0] < 0xE0 else 3 if 0xE0 <= raw[0] < 0xF0 else 4 if 0xF0 <= raw[0] < 0xF5 else 0
            return size == n == len(raw) and all(0x80 <= x < 0xC0 for x in raw[1:])

        while end < len(text) and (n := next((n for n in (2, 3, 4) if whole(end, n)), 0)):
            end += n
        while n := next((n for n in (2, 3, 4) if start - n >= floor and whole(start - n, n)), 0):
            start -= n
        return start, end

    def _spans_restored(self, text: str, utf8: bool) -> str:
        """Every run of forms decoded by the pair that explains most of it, and of all runs among equals."""
        spans = self._spans(text, utf8)
        overall: dict[tuple, int] = {}
        for _, _, pairs in spans:
            for p, n in pairs.items():
                overall[p] = overall.get(p, 0) + n
        out, at = [], 0
        for start, end, pairs in spans:
            if start < at:
                continue  # inside the span before, which was extended
            for true, wrong in sorted(pairs, key=lambda p: (-pairs[p], -overall[p], p)):
                a, b = (start, end) if not utf8 or wrong in MULTIBYTE else self._extended(text, start, end, at, wrong)
                got = ungarble(text[a:b], true, wrong)
                if got is None:
                    a, b = start, end
                    got = ungarble(text[a:b], true, wrong)
                if got is not None and REPLACEMENT not in got and (utf8 or not any("\x80" <= c <= "\x9f" for c in got)):
                    out += [text[at:a], got]
                    at = b
                    break
        out.append(text[at:])
        return "".join(out)

    def _strange(self, text: str) -> int:
        """How many of the sequences of a text, blanks around it, clean text does not have."""
        s = f" {text} ".translate(_DIGITS)
        return sum(not x.isascii() and x not in self.clean for x in (s[i : i + 3] for i in range(len(s) - 2)))

    def _words_restored(self, text: str, true: str, wrong: str) -> str:
        """Every word, or what of it can be bytes in the wrong encoding, decoded again where that makes it less strange."""
        table = _chars_to_bytes(wrong)

        def better(m: regex.Match) -> str:
            word, out = m[0], []
            if word.isascii() or not self._strange(word):
                return word
            for run in itertools.groupby(word, key=lambda c: c in table):
                piece = "".join(run[1])
                got = ungarble(piece, true, wrong) if run[0] and not piece.isascii() else None
                out.append(piece if got is None or REPLACEMENT in got else got)
            new = "".join(out)
            return new if self._strange(new) < self._strange(word) else word

        return _SAID.sub(better, text)

    def _damage(self, text: str) -> tuple[int, int]:
        covered = sum(e - s for s, e, _ in self._spans(text, True)) + sum(e - s for s, e, _ in self._spans(text, False))
        return sum(self._strange(m[0]) for m in _SAID.finditer(text) if not m[0].isascii()), covered

    def _once(self, text: str) -> str:
        """The least damaged of what one round can make of a text; the text itself if none is less damaged."""
        overall: dict[tuple, int] = {}
        for _, _, pairs in self._spans(text, False):
            for p, n in pairs.items():
                overall[p] = overall.get(p, 0) + n
        likely = [p for p in sorted(overall, key=lambda p: (-overall[p], p)) if p[1] not in MULTIBYTE][:LIKELY]
        made = [self._spans_restored(text, True), *(self._words_restored(text, *p) for p in likely), self._spans_restored(text, False)]
        return min([text, *made], key=self._damage) if any(x != text for x in made) else text

    def repair(self, text: str | None) -> tuple[str | None, bool]:
        """The text with every span restored that can be, and whether nothing garbled is left."""
        while self.is_garbled(text):
            new = self._once(text)
            if new == text:
                break
            text = new  # less damaged each time, so this ends
        return text, not self.is_garbled(text)


@lru_cache(maxsize=4)
def _detector(sequences: tuple[str, ...]) -> GarbleDetector:
    return GarbleDetector(sequences)


def _suspect(df: DataFrame, text: str) -> Column:
    """Whether a text, or one of an array of texts, has a character that is not ASCII; the others need no automaton."""
    strange = lambda c: F.coalesce(c.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return F.coalesce(F.exists(text, strange), F.lit(False)) if isinstance(df.schema[text].dataType, T.ArrayType) else strange(F.col(text))


def garbled_rows(df: DataFrame, text: str, sequences: list[str], garbled: bool = True) -> DataFrame:
    """The rows of df whose text is garbled, in whole or in part, or those whose text is not.

    text: a column of strings, or of arrays of strings, whose evidence then counts together. Null and empty texts
    never are garbled. sequences: see clean_sequences; they travel with the task.
    """
    known, at = tuple(sequences), df.columns.index(text)
    single = not isinstance(df.schema[text].dataType, T.ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(known)
        for batch in batches:
            values = batch.column(at).to_pylist()
            yield batch.filter(pa.array([detector.is_garbled(*([v] if single else v or [])) == garbled for v in values], pa.bool_()))

    suspect = _suspect(df, text)
    judged = df.filter(suspect).mapInArrow(run, df.schema)
    return judged if garbled else judged.unionByName(df.filter(~suspect))


def repaired_rows(df: DataFrame, text: str, sequences: list[str]) -> DataFrame:
    """The garbled rows with ``restored`` (the text, as far as it can be restored) and ``complete`` (nothing garbled is left); columns of these names are replaced."""
    df = df.drop(*({"restored", "complete"} - {text}))
    known, at = tuple(sequences), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(known)
        for batch in batches:
            batch = batch.filter(pa.array([detector.is_garbled(t.as_py()) for t in batch.column(at)], pa.bool_()))
            done = [detector.repair(t.as_py()) for t in batch.column(at)]
            cols = [*batch.columns, pa.array([t for t, _ in done], pa.string()), pa.array([c for _, c in done], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "restored", "complete"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.filter(_suspect(df, text)).mapInArrow(run, f"{fields}, restored string, complete boolean")
