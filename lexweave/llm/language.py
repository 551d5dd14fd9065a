"""Languages of documents and of their segments, by rank-order profiles.

A profile lists the most frequent character n-grams of a language by rank. The out-of-place distance of a text to a
profile is the mean over the text's most frequent distinct n-grams of how far each one's rank in the text is from its
rank in the profile, or the profile's length where it does not occur there. The nearest profile names the language; how much
farther the second nearest is gives the confidence. Profiles are trained on a bounded sample of labelled texts, whose
labels may be wrong: they are fitted in passes, the later ones on the sentences that the fit before agrees with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexweave.llm.sentences import split_sentences

#: What names a language, besides its two-letter code.
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français", "es": "spa spanish español castellano",
    "it": "ita italian italiano", "pt": "por portuguese português", "nl": "nld dut dutch nederlands", "pl": "pol polish polski",
    "ru": "rus russian русский", "el": "ell gre greek ελληνικά", "zh": "zho chi chinese 中文 汉语", "ja": "jpn japanese 日本語",
    "ar": "ara arabic العربية", "hi": "hin hindi हिन्दी", "th": "tha thai ไทย",
}
#: Labels that name no language.
NO_LANGUAGE = "und unknown none null nan n/a na mul mis zxx xx ? ?? - -- other".split()
#: Most labelled texts a language that profiles are fitted on, and the longest such text: they are sent to the driver.
MAX_TEXTS, MAX_LENGTH = 150, 20_000
#: n-grams of a profile, and of a text that is compared with it.
PROFILE, COMPARED = 3_000, 400
#: A sentence counts as foreign in its text if the text's own language is farther by this part.
MARGIN = 0.04
#: Words whose n-grams a worker remembers.
REMEMBERED = 100_000
#: n-grams that are ranked at once.
AT_ONCE = 200_000

_WORD = regex.compile(r"[\p{L}\p{M}]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_BRACKETS = regex.compile(r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）|<[^<>\n]{1,40}>")
_HEADING = regex.compile(r"(?m)^[^\p{L}\n§(]{0,12}§+[^\S\n]*\d[^\n]{0,80}$")
_ENDS = regex.compile(r"[.!?…。！？।؟;;»”“」』\"']\s*$")


def label_language(c: Column) -> Column:
    """The two-letter code that a label means, in any case, code or spelling and with any region; null if it names none."""
    s = F.lower(F.trim(F.regexp_replace(c, r"[\s\x{00A0}]+", " ")))
    s = F.regexp_replace(s, r"^([^-_ ]+)[-_].*$", "$1")
    named = {name: code for code, names in NAMES.items() for name in (code, *names.split())} | dict.fromkeys(NO_LANGUAGE, "")
    known = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    out = F.transform(F.array(s), lambda x: F.when(x.rlike(r"\p{L}"), F.coalesce(F.try_element_at(known, x), x)))
    return F.nullif(F.element_at(out, 1), F.lit(""))


def _word_ngrams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if not (n == 1 and w[i] == "_")]


def _words(text: str) -> Iterator[str]:
    """Lower-case words; very long ones (scripts without blanks) in pieces."""
    for m in _WORD.finditer(text.lower()):
        w = m[0]
        if len(w) <= 40:
            yield w
        else:
            yield from (w[i : i + 40] for i in range(0, len(w), 40))


class LanguageProfiles:
    def __init__(self, profiles: dict[str, list[str]]) -> None:
        self.languages = sorted(profiles)
        self.size = max(map(len, profiles.values()), default=1)
        grams = sorted({g for p in profiles.values() for g in p})
        self.known = len(grams)
        self.number = {g: i for i, g in enumerate(grams)}
        self.ranks = np.full((len(grams) + 1, len(self.languages)), 2 * self.size + COMPARED, dtype=np.int16)  # out of place by all, wherever it is
        for j, lang in enumerate(self.languages):
            for r, g in enumerate(profiles[lang]):
                self.ranks[self.number[g], j] = r
        self.words: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, counts: dict[str, Counter], size: int = PROFILE) -> LanguageProfiles:
        return cls({lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]] for lang, c in counts.items() if c})

    def __getstate__(self) -> dict:
        """What travels to a task: without the words met so far."""
        return self.__dict__ | {"words": {}, "number": {g: i for g, i in self.number.items() if i < self.known}}

    def _numbers(self, word: str) -> np.ndarray:
        """The numbers of a word's n-grams; remembered by word. Those that no profile has are numbered as they come, after all others."""
        got = self.words.get(word)
        if got is None:
            number = self.number
            got = self.words[word] = np.array([number.setdefault(g, len(number)) for g in _word_ngrams(word)], dtype=np.int64)
        return got

    def _forget(self) -> None:
        if len(self.words) >= REMEMBERED:
            self.words.clear()
            self.number = {g: i for g, i in self.number.items() if i < self.known}

    def distances(self, texts: list[str]) -> np.ndarray:
        """Out-of-place distance of each text to each language, from 0 to 1; 1 for texts without words."""
        out = np.ones((len(texts), len(self.languages)))
        found: list[np.ndarray] = []
        owner: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            parts = [self._numbers(w) for w in _words(text)]
            found += parts
            owner += [i] * len(parts)
            held += sum(map(len, parts))
            if held >= AT_ONCE:
                self._compare(found, owner, out)
                found, owner, held = [], [], 0
                self._forget()
        if found:
            self._compare(found, owner, out)
            self._forget()
        return out

    def _compare(self, found: list[np.ndarray], owner: list[int], out: np.ndarray) -> None:
        grams, base = np.concatenate(found), len(self.number)
        keys = np.sort(np.repeat(np.array(owner, dtype=np.int64), [len(x) for x in found]) * base + grams)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(starts, len(keys)))
        text, gram = np.divmod(keys[starts], base)
        # one number orders by text, then by falling count, then by n-gram
        most = int(counts.max()) + 1
        keys = np.sort((text * most + (most - counts)) * base + gram)
        text, gram = np.divmod(keys, base)
        text //= most
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        rank = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
        if int(rank.max()) >= COMPARED:
            kept = rank < COMPARED
            text, gram, rank = text[kept], gram[kept], rank[kept]
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        away = self.ranks[np.minimum(gram, self.known)]
        away -= rank.astype(np.int16)[:, None]
        np.minimum(np.abs(away, out=away), self.size, out=away)
        out[text[first]] = np.add.reduceat(away, first, axis=0, dtype=np.int32) / (self.size * np.diff(np.append(first, len(text))))[:, None]


def whole_sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words to judge by) of the sentences of a text that show its language.

    What stands in brackets, marker strings, section headings and units without an end mark that are too short for a
    sentence are left out.
    """
    plain = _HEADING.sub(lambda m: "\n" * 2 + " " * (len(m[0]) - 2), text)
    out = []
    for a, b in split_sentences(plain):
        said = _BRACKETS.sub(" ", plain[a:b])
        words = _WORD.findall(said)
        letters = sum(map(len, words))
        if not words or letters < 3:
            continue
        unspaced = bool(_UNSPACED.search(said))
        if not _ENDS.search(said) and (letters < 8 if unspaced else len(words) < 5):
            continue
        out.append((a, b, said))
    return out


def judge(texts: list[str | None], profiles: LanguageProfiles, margin: float = MARGIN) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, language, confidence) of the segments of each text: neighbouring sentences of one language.

    Texts without words, and null ones, have none.
    """
    units = [whole_sentences(t) if t and profiles.languages else [] for t in texts]
    distances = profiles.distances([said for u in units for _, _, said in u])
    ends = np.cumsum([len(u) for u in units])
    return [_segments(u, distances[e - len(u) : e], profiles, margin) if u else [] for u, e in zip(units, ends)]


def _segments(units: list[tuple[int, int, str]], distances: np.ndarray, profiles: LanguageProfiles, margin: float) -> list[tuple[int, int, str, float]]:
    own = Counter(int(d.argmin()) for d in distances)
    main = min(own, key=lambda i: (-own[i], sum(float(d[i]) for d in distances)))
    out: list[list] = []
    for (a, b, said), d in zip(units, distances):
        best = int(d.argmin())
        if best != main and d[main] - d[best] < margin * d[main]:
            best = main
        second = float(np.partition(np.delete(d, best), 0)[0]) if len(d) > 1 else 1.0
        confidence = max(0.0, min(1.0, (second - float(d[best])) / second if second else 0.0))
        weight = b - a
        if out and out[-1][2] == best:
            seg = out[-1]
            seg[3] = (seg[3] * seg[4] + confidence * weight) / (seg[4] + weight)
            seg[4] += weight
            seg[1] = b
        else:
            out.append([a, b, best, confidence, weight])
    return [(a, b, profiles.languages[i], c) for a, b, i, c, _ in out]


def fit_profiles(docs: DataFrame, text: str, label: str, max_texts: int = MAX_TEXTS, max_length: int = MAX_LENGTH) -> LanguageProfiles:
    """Profiles of the languages of NAMES, from at most max_texts labelled texts each (those of the lowest hash)."""
    rows = docs.select(label_language(F.col(label)).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("lang").isin(list(NAMES)) & (F.length("text") <= max_length) & F.col("text").rlike(r"\p{L}"))
    order = W.Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    sample = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_texts).select("lang", "text").collect()
    return fit_from_texts([(r["lang"], [said for _, _, said in whole_sentences(r["text"])]) for r in sample])


def fit_from_texts(labelled: list[tuple[str, list[str]]], passes: int = 3) -> LanguageProfiles:
    """Profiles from (label, sentences) of texts. After the first pass a text counts only if most of its sentences are
    nearest to its label, and of it only those that are: wrong labels and foreign stretches drop out."""
    profiles = LanguageProfiles({})
    for _ in range(passes):
        counts: dict[str, Counter] = {}
        nearest = iter(profiles.distances([s for _, sentences in labelled for s in sentences]).argmin(axis=1)) if profiles.languages else None
        for lang, sentences in labelled:
            if nearest is not None:
                agree = [s for s in sentences if profiles.languages[next(nearest)] == lang]
                if 2 * len(agree) <= len(sentences):
                    continue
                sentences = agree
            own = counts.setdefault(lang, Counter())
            for s in sentences:
                for w in _words(s):
                    own.update(_word_ngrams(w))
        profiles = LanguageProfiles.fit(counts)
    return profiles


def with_languages(df: DataFrame, text: str, profiles: LanguageProfiles, margin: float = MARGIN) -> DataFrame:
    """df without text and with ``segments``: array of (seg_start, seg_end, lang, confidence), empty where there is no word.
    A column called segments is replaced.

    Offsets count code points, the end is exclusive. The profiles travel with the task (PROFILE n-grams a language).
    """
    keep = [c for c in df.columns if c not in (text, "segments")]
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    kind = pa.list_(pa.struct([("seg_start", pa.int32()), ("seg_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = judge(batch.column(len(keep)).to_pylist(), profiles, margin)
            found = [[dict(zip(("seg_start", "seg_end", "lang", "confidence"), s)) for s in segments] for segments in judged]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "segments"])

    return df.select(*keep, text).mapInArrow(run, f"{fields}, segments array<struct<seg_start: int, seg_end: int, lang: string, confidence: double>>")


def wrong_labels(df: DataFrame, key: list[str], label: str, segments: str = "segments") -> DataFrame:
    """(key..., lang): for each text whose label is missing or wrong, or that has several languages, one row per language.

    A label is right if it names the text's only language in any spelling. Texts without words give no row.
    """
    langs = F.array_distinct(F.transform(F.col(segments), lambda s: s["lang"]))
    named = df.select(*key, label_language(F.col(label)).alias("_label"), langs.alias("_langs"))
    case = F.col("_label").isNull() | (F.size("_langs") > 1) | (F.element_at("_langs", 1) != F.col("_label"))
    return named.filter((F.size("_langs") > 0) & case).select(*key, F.explode("_langs").alias("lang"))
