"""Texts decoded with a wrong character encoding.

Method: minimum description length. Every candidate decoding of a suspicious
stretch is compressed with a zstandard dictionary of its language; the chain of
steps whose compressed size plus cost is smallest wins, and a stretch that no
chain makes shorter stays as it is. Everything that is learned comes from all
sound texts, which most are: characters, words and pairs of frequent words are
counted over them, languages are the clusters that the frequent words and scripts
fall into by the texts that they share, and the dictionary of a language is
trained on parts that hold all of its texts and then on the parts' dictionaries.

A step encodes the text in the encoding that it was wrongly read with and
decodes the bytes as what they were. Steps that end in UTF-8 check themselves,
because few byte sequences are valid, and so apply to single runs in a text;
steps that end in another encoding are tried sentence by sentence. A step that
leads to characters which cost no less to name cannot shorten a description and
is not compressed.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.runtime import materialize, spread

#: Encodings that UTF-8 bytes get read with.
UTF8_VIEWS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2")
#: (read with, is really) of one-byte and of double-byte texts.
SINGLE = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1253"), ("cp1252", "cp1254"), ("cp1252", "iso8859_2"),
    ("iso8859_2", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"),
)
DOUBLE = (("cp1252", "gb18030"), ("cp1252", "cp932"), ("cp1252", "cp949"), ("cp1252", "big5hkscs"))
STEP_COST = 5
#: Writing a sentence in capitals; a word in two scripts, or with signs of line drawing; a character that no text has.
CASE_COST, MIXED_COST, UNSEEN = 2, 6, 1.75
#: A character of a block (of 256) that no text is written in; a replacement or control character, which no writer types.
STRANGE, LOST = 6, 10
#: Bytes of a dictionary; bytes of text that are trained on at once, and dictionaries that are then merged at once.
DICTIONARY_BYTES, PART_BYTES, MERGED = 24_576, 1 << 22, 64
#: Of the training: bytes of a segment and of what is counted, and of a sample at most.
SEGMENT, COUNTED, PIECE = 50, 8, 4096
#: The first three distances that are tried again, which close the header of a dictionary.
HEADER_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
#: Different words that a task counts before it passes the counts on; entries that it keeps about characters.
HELD, KEPT = 1 << 19, 1 << 16
#: Clusters, at most; texts for each; frequent words that they are told apart by.
LANGUAGES, LANGUAGE_TEXTS, FREQUENT_WORDS = 12, 150, 400


def _table(codec: str) -> dict[int, str]:
    """Byte to character; bytes that the codec leaves open stand for themselves."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_decode = {c: _table(c) for c in {*UTF8_VIEWS, *(x for pair in SINGLE for x in pair)}}
#: Character to Latin-1 character, so that translate() and encode("latin-1") give the bytes. C1 controls stand for their bytes in every encoding.
_encode = {c: {**{ord(chr(b)): chr(b) for b in range(128, 160)}, **{ord(ch): chr(b) for b, ch in t.items()}} for c, t in _decode.items()}


def _utf8_runs(codec: str) -> re.Pattern:
    """Runs of characters whose bytes in the codec look like one or more UTF-8 characters."""
    t = _decode[codec]

    def some(a: int, b: int) -> str:
        chars = {t[x] for x in range(a, b + 1)} | {chr(x) for x in range(a, b + 1) if 128 <= x < 160}
        return "[" + "".join(re.escape(x) for x in sorted(chars)) + "]"

    tail = some(0x80, 0xBF)
    # A no-break space often comes back as a plain one.
    loose = tail[:-1] + " ]" if codec in ("cp1252", "cp1250") else tail
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{tail}|{some(0xF0, 0xF4)}{tail}{tail}{tail}|{some(0xE0, 0xEF)}{tail}{loose}(?!\\w))+")


_runs = {c: _utf8_runs(c) for c in UTF8_VIEWS}
_han = re.compile(r"[㐀-鿿]")
_wide = re.compile(r"[^\x00-\x7f]")
_pair = re.compile(r"[^\x00-\x7f]{2}")
#: All that a run of misread UTF-8 can be in.
_stretch = re.compile(r"[^\x00-\x7f]{2,}(?: ?(?!\w))?")
_lost = re.compile(r"[�\x80-\x9f]")
_lost_signs = frozenset(map(chr, [0xFFFD, *range(0x80, 0xA0)]))
_mixed = re.compile(r"[A-Za-zÀ-ɏ][Ѐ-ӿ╀-▟]|[Ѐ-ӿ╀-▟][A-Za-zÀ-ɏ]|[Α-ω][A-Za-z]|[A-Za-z][Α-ω]|(?<=[^\W\d_])[¡-©¬-±´-¶¸»-¿](?=[^\W\d_])|(?<!\w)[¢-©¬®¯°±´¶¸][^\W\d_]{2}")
#: Without one of these characters no word is mixed.
_mixable = frozenset(map(chr, [*range(0xA1, 0xC0), *range(0x391, 0x3CA), *range(0x400, 0x500), *range(0x2500, 0x25A0)]))
#: Words of a script that a step leads to; signs that merely turn into its letters do not make one.
_scripts = {c: re.compile(r"[а-яё]{3}", re.I) for c in ("cp1251", "koi8_r", "cp866")} | {c: re.compile(r"[㐀-鿿぀-ヿ가-힣]{2}") for _, c in DOUBLE} | {"cp1253": re.compile(r"[α-ωά-ώ]{3}", re.I)}
#: Line drawing that stands on its own, as in file trees.
_lines = frozenset("─│┌┐└┘├┤┬┴┼═║")
_tree = re.compile(r"(?<!\S)[─│┌┐└┘├┤┬┴┼═║]+(?!\S)")
_sentence = re.compile(r"[^.!?\n。！？]*(?:[.!?\n。！？]+[\"”’»)]*\s*|$)")
#: A sequence in quotes on its own is being talked about.
_quoted = re.compile(r"(?<=[“\"‘„«])[^\x00-\x7f\w]{0,2}[^\x00-\x7f][^\x00-\x7f ]{0,3}(?=[”\"’“»])")


def _mixes(text: str, signs: set[str]) -> int:
    """How many words mix scripts."""
    # A mixed word has one of the characters, so the others need not be looked at.
    return 0 if signs.isdisjoint(_mixable) else len(_mixed.findall(" ".join(w for w in text.split() if not _mixable.isdisjoint(w))))


def _bytes(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError as e:
        if text[e.start] > "\xff":
            return None
    # What the codec lacks may still stand for its byte.
    try:
        return text.translate(_encode[codec]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _text(raw: bytes, codec: str) -> str:
    """The bytes decoded, those that the codec leaves open as themselves."""
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return raw.decode("latin-1").translate(_decode[codec])


def _from_utf8(text: str, codec: str) -> str:
    """The text with the runs decoded that are UTF-8 read with the codec."""

    def one(m: re.Match) -> str:
        raw = _bytes(m.group(), codec)
        if raw is None:
            return m.group()
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            try:
                return raw.replace(b" ", b"\xa0").decode("utf-8")
            except UnicodeDecodeError:
                return m.group()

    return _runs[codec].sub(one, text)


def _from_gbk(text: str) -> str | None:
    """UTF-8 that was read as GBK; bytes that were lost on the way become replacement characters."""
    raw = text.replace("�", "?").encode("gb18030", "replace")
    back = raw.decode("utf-8", "replace")
    lost, right = back.count("�"), len(_wide.findall(back)) - back.count("�")
    return back if right > 2 * lost and right else None


#: Character to character for each one-byte step; characters that the first encoding lacks are missing.
_steps = {(view, real): {chr(ch): _decode[real][ord(byte)] for ch, byte in _encode[view].items() if ord(byte) > 127} for view, real in SINGLE}


@lru_cache(1 << 16)
def _block(ch: str) -> int:
    """The block of 256 characters, all Chinese ones being one, and all Korean ones."""
    block = ord(ch) >> 8
    return 0x4E if 0x34 <= block <= 0x9F else 0xAC if 0xAC <= block <= 0xD7 else block


_ascii = bytes(range(128))


def _signs(text: str) -> set[str]:
    """The different characters that are not ASCII."""
    return set(text.encode("utf-8", "surrogatepass").translate(None, _ascii).decode("utf-8", "surrogatepass"))


def _wide_count(text: str) -> int:
    return len(text) - len(text.encode("ascii", "ignore"))


def _words(text: str) -> set[str]:
    """The different pieces between white space; those of letters alone are words."""
    return set(text.lower().split())


#: Stretches up to this length recur, and what is found for them is kept.
_SHORT = 16


def _views_of(stretch: str) -> tuple[str, ...]:
    """Encodings that bytes of the stretch may be UTF-8 read with."""
    return tuple(c for c in UTF8_VIEWS if _runs[c].search(stretch))


_views_kept = lru_cache(1 << 15)(_views_of)


def _views(text: str) -> set[str]:
    return {c for x in set(_stretch.findall(text)) for c in (_views_kept(x) if len(x) <= _SHORT else _views_of(x))}


def _readings_of(stretch: str) -> tuple[frozenset[str], ...]:
    """The characters that each run of the stretch gives when it is read as UTF-8, once or more often."""
    seen, left = {stretch}, [stretch]
    while left:
        text = left.pop()
        for codec in UTF8_VIEWS:
            for m in _runs[codec].finditer(text):
                back = _from_utf8(m.group(), codec)
                if back != m.group() and back not in seen:
                    seen.add(back)
                    left.append(back)
    return tuple({frozenset(_signs(x)) for x in seen - {stretch}})


_readings_kept = lru_cache(1 << 15)(_readings_of)


@dataclass
class Languages:
    """Clusters of texts by frequent words and blocks of characters."""

    features: dict[str, int]
    weights: np.ndarray
    #: For a block of characters, the cluster that is written in it.
    blocks: dict[int, int]

    def of(self, text: str) -> int:
        """The cluster that the text is nearest to."""
        return int(self.weights[_known(text, self.features)].sum(0).argmax())

    def nearest(self, at: pa.ListArray) -> np.ndarray:
        """The clusters that texts with these features are nearest to."""
        return (_dense(at, len(self.features)) @ self.weights).argmax(1)


def _written(text: str) -> list[str]:
    """Scripts as features: texts without blanks have no words, and what block their letters are from tells as much as some words."""
    letters = len(text) - text.count(" ")
    if 4 * _wide_count(text) <= letters:
        return []
    blocks: Counter = Counter()
    for ch, n in Counter(_wide.findall(text)).items():
        if ch.isalpha():
            blocks[_block(ch)] += n
    return [f"\x00{b}" for b, n in blocks.items() if b > 1 and 4 * n > letters]


def _known(text: str, features: dict[str, int]) -> list[int]:
    """The features that the text has, words of letters and scripts."""
    at = [features[w] for w in features.keys() & _words(text) if w.isalpha()]
    return at + [features[b] for b in _written(text) if b in features]


def _frequent(counted: Iterable[tuple[str, int]], number: int) -> list[tuple[str, int]]:
    """Features that tell clusters apart, of so many texts: scripts first, then the most frequent words."""
    return sorted((x for x in counted if x[1] >= _least(number)), key=lambda x: (x[0][0] != "\x00", -x[1], x[0]))[:FREQUENT_WORDS]


def _least(number: int) -> int:
    """Texts that a feature is in at least."""
    return max(3, number // 200)


def _dense(at: pa.ListArray, width: int) -> np.ndarray:
    """A row for each text, 1 where it has the feature."""
    x = np.zeros((len(at), width))
    x[np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = 1
    return x


def _together(rows: Iterable[pa.ListArray], width: int) -> np.ndarray:
    """In how many texts each pair of features is."""
    total = np.zeros((width, width), np.int64)
    for at in rows:
        x = _dense(at, width).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    return total


def _languages(names: list[str], together: np.ndarray, number: int) -> Languages:
    """Spherical k-means of the features by the texts that they share, from features that lie far apart; the same for the same counts."""
    # What nearly all texts have tells little; a script tells as much as several words.
    tells = np.array([(8 if f[0] == "\x00" else 1) * math.log(1 + number / n) for f, n in zip(names, together.diagonal(), strict=True)])
    x = together * tells[:, None] * tells
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    mass = tells * together.diagonal()
    if not names:
        return Languages({}, np.zeros((0, 1)), {})
    usual = x @ (mass @ x / mass.sum())
    centres = [x[int(usual.argmax())]]
    for _ in range(min(LANGUAGES, number // LANGUAGE_TEXTS, len(names)) - 1):
        # The feature farthest from all centres, of those that share texts with others.
        centres.append(x[int(((x @ np.array(centres).T).max(1) - usual).argmin())])
    for _ in range(8):
        nearest = (x @ np.array(centres).T).argmax(1)
        centres = [m / max(1e-9, np.linalg.norm(m)) for m in (mass[nearest == k] @ x[nearest == k] if (nearest == k).any() else c for k, c in enumerate(centres))]
    # Whole numbers, so that sums are the same in any order.
    weights = np.round(np.array(centres).T * tells[:, None] * (1 << 20))
    return Languages({f: i for i, f in enumerate(names)}, weights, {int(f[1:]): int(weights[i].argmax()) for i, f in enumerate(names) if f[0] == "\x00"})


@dataclass
class Dictionaries:
    """Trained zstandard dictionaries by cluster, and what naming a character costs."""

    data: dict[int, bytes]
    languages: Languages
    #: Bytes that naming a character costs, by how many texts have it; UNSEEN for the others.
    naming: dict[str, float]
    blocks: frozenset[int]
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"data": self.data, "languages": self.languages, "naming": self.naming, "blocks": self.blocks, "_made": {}}

    def size(self, text: str, language: int) -> int:
        """Compressed bytes under the language's dictionary."""
        made = self._made.get(language)
        if made is None:
            data = self.data.get(language)
            options = dict(write_checksum=False, write_content_size=False, write_dict_id=False)
            parameters = zstandard.ZstdCompressionParameters.from_level(3, **options)
            given = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
            made = self._made[language] = zstandard.ZstdCompressor(compression_params=parameters, **given)
        return len(made.compress(text.encode("utf-8", "replace")))

    def name(self, ch: str) -> float:
        """Bytes that it costs to say which character this is."""
        cost = self.naming.get(ch)
        if cost is None:
            cost = self.naming[ch] = LOST if _lost.match(ch) else UNSEEN if _block(ch) in self.blocks else STRANGE
        return cost

    def gains(self, signs: set[str], slack: float) -> list[tuple[str, str]]:
        """The one-byte steps that make characters cheaper to name, or dearer by less than the slack."""
        key = frozenset(signs), slack
        if (kept := self._made.get(key)) is not None:
            return kept
        total = np.zeros(len(_steps))
        for ch in sorted(signs):
            own = self._made.get(ch)
            if own is None:
                backs = [to.get(ch) for to in _steps.values()]
                own = self._made[ch] = np.array([-math.inf if b is None else self.name(ch) - (self.name(b) if ord(b) > 127 else 0) for b in backs])
            total += own
        steps = list(_steps)
        gained = [steps[k] for k in np.flatnonzero(total > -slack)]
        if len(signs) <= _SHORT:
            if len(self._made) > KEPT:
                self._made.clear()
            self._made[key] = gained
        return gained

    def length(self, text: str, usual: int | _Usual) -> float:
        """Description length in bytes: the text, its unusual characters, and words that mix scripts.

        The text is written in the usual language or in one of the scripts in it.
        """
        signs = _signs(text)
        blocks = self.languages.blocks
        languages = {operator.index(usual), *(blocks[b] for b in set(map(_block, signs)) if b in blocks)}
        plain = min(self.size(text, x) for x in languages)
        if text.isupper():
            plain = min(plain, CASE_COST + min(self.size(text.lower(), x) for x in languages))
        naming = self.naming
        return plain + sum([naming[ch] if ch in naming else self.name(ch) for ch in sorted(signs)]) + MIXED_COST * _mixes(text, signs)


def _misread(text: str, usual: set[str]) -> bool:
    """Whether a run of the text, read as UTF-8, or a sentence of it, read as another script, is made of characters that many texts have."""
    stretches = set(_stretch.findall(text))
    if any(signs <= usual for x in stretches for signs in (_readings_kept(x) if len(x) <= _SHORT else _readings_of(x))):
        return True
    # Three times two letters of two bytes are the fewest that count below.
    if not stretches or _wide_count(text) < 6:
        return False
    for part in _sentence.findall(text):
        raw = _bytes(part, "cp1252") if _wide_count(part) >= 6 and _pair.search(part) else None
        for real in _scripts if raw else ():
            back = _text(raw, real) if real in _decode else raw.decode(real, "replace")
            if len(_scripts[real].findall(back)) > 2 and all(ch in usual for ch in _signs(back)):
                return True
    return False


def count_characters(texts: Iterable[str]) -> Counter:
    """In how many texts each character is that is not ASCII."""
    seen: Counter = Counter()
    for text in texts:
        seen.update(_signs(text))
    return seen


def usual_characters(counted: Iterable[tuple[str, int]], number: int) -> set[str]:
    """Characters that at least one in fifty texts has."""
    return {ch for ch, n in counted if n >= max(3, number // 50)}


def is_sound(text: str, usual: set[str]) -> bool:
    """Whether one may learn from the text: those with lost characters or misread runs would make an error that is frequent pass for the usual spelling."""
    return text.isascii() or not (_lost.search(text) or _misread(text, usual))


def _words_only(seen: Counter) -> dict[str, int]:
    return {w: n for w, n in seen.items() if w.isalpha()}


def _samples(texts: Iterable[str]) -> Iterator[bytes]:
    """The sentences, those that are long in pieces."""
    for text in texts:
        for part in _sentence.findall(text):
            if part.strip():
                raw = part.encode("utf-8", "replace")
                yield from (raw[i : i + PIECE] for i in range(0, len(raw), PIECE))


def _trained_on(samples: list[bytes], size: int) -> bytes | None:
    """A dictionary trained on all the samples; None if they are too little text."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return None


def _merged(made: list[bytes], size: int) -> bytes:
    """One dictionary from those of several parts."""
    if len(made) == 1:
        return made[0]
    contents = sorted(x.split(HEADER_END, 1)[-1] for x in made)
    # Pieces of which even two short contents give enough.
    piece = max(COUNTED, min(size, sum(map(len, contents))) // 8)
    return _trained_on([c[i : i + piece] for c in contents for i in range(0, len(c), piece)], size) or b"".join(sorted(set(contents)))[-size:]


def _size(total: int, size: int) -> int:
    """Bytes of the dictionary of a cluster with so many bytes of text."""
    return min(size, max(1024, total // 8))


def _dictionaries(data: dict[int, bytes], languages: Languages, seen: dict[str, int], number: int) -> Dictionaries:
    naming = {ch: math.log2(number / n) / 8 for ch, n in seen.items()}
    blocks = frozenset(_block(ch) for ch, n in seen.items() if n >= 3) | {0, 1, 0x20}
    return Dictionaries(data, languages, naming, blocks)


def train(texts: list[str], size: int = DICTIONARY_BYTES) -> Dictionaries:
    """Dictionaries by cluster from texts in memory; a cluster with too little text goes without."""
    usual = usual_characters(count_characters(texts).items(), len(texts))
    sound = [t for t in texts if is_sound(t, usual)]
    words, scripts = Counter(w for t in sound for w in _words(t)), Counter(b for t in sound for b in _written(t))
    names = [f for f, _ in _frequent([*_words_only(words).items(), *scripts.items()], len(sound))]
    features = {f: i for i, f in enumerate(names)}
    at = pa.array([_known(t, features) for t in sound], pa.list_(pa.int32()))
    languages = _languages(names, _together((at[i : i + 4096] for i in range(0, len(at), 4096)), len(names)), len(sound))
    by: dict[int, list[str]] = {}
    for text in sound:
        by.setdefault(languages.of(text), []).append(text)
    made = {language: _trained_on(list(_samples(own)), _size(sum(len(t.encode("utf-8", "replace")) for t in own), size)) for language, own in sorted(by.items())}
    return _dictionaries({k: v for k, v in made.items() if v}, languages, count_characters(sound), max(1, len(texts)))


@dataclass
class Repair:
    """A garbled text: what could be restored, by which steps, and whether characters are lost."""

    text: str
    chain: list[str]
    lost: bool


class _Usual:
    """The language of a text, found when it is first asked for: most texts have no step worth a look."""

    def __init__(self, text: str, languages: Languages):
        self.text, self.languages, self.own = text, languages, None

    def __index__(self) -> int:
        if self.own is None:
            self.own = self.languages.of(self.text)
        return self.own


def _singles(text: str, known: Dictionaries, usual: int | _Usual) -> tuple[str, list[str]]:
    """The text with the sentences restored that were read with a wrong one-byte or double-byte encoding, and the steps."""
    parts = _sentence.findall(text)
    steps: dict[tuple[str, str], None] = {}
    changed: dict[int, str] = {}

    read: dict[str, tuple[str, bytes | None]] = {}

    def decoded(part: str, view: str, real: str) -> str | None:
        if read.get(view, ("",))[0] is not part:
            read[view] = part, _bytes(part, view)
        raw = read[view][1]
        if (view, real) in _steps:
            back = None if raw is None else _text(raw, real)
        else:
            try:
                back = None if raw is None else raw.decode(real)
            except UnicodeDecodeError:
                return None
        if back is None or back == part or _lost.search(back):
            return None
        return back if real not in _scripts or len(_scripts[real].findall(back)) > len(_scripts[real].findall(part)) // 2 else None

    for k, part in enumerate(parts):
        if part.isascii():
            continue
        signs = _signs(part)
        tried = known.gains(signs, MIXED_COST * _mixes(part, signs)) + (list(DOUBLE) if _pair.search(part) else [])
        # Steps that give the same text count once, the first of them.
        backs: dict[str, tuple[str, str]] = {}
        for step in tried:
            if (back := decoded(part, *step)) is not None:
                backs.setdefault(back, step)
        if not backs:
            continue
        best, choice = known.length(part, usual), None
        for back, step in backs.items():
            if (cost := known.length(back, usual) + STEP_COST) < best:
                best, choice = cost, (step, back)
        if choice:
            steps[choice[0]] = None
            changed[k] = choice[1]
    if not steps:
        return text, []
    # What has been found in one sentence is free in the others.
    for k, part in enumerate(parts):
        if k not in changed and not part.isascii():
            best = known.length(part, usual)
            for step in steps:
                back = decoded(part, *step)
                if back is not None and (cost := known.length(back, usual)) < best:
                    best, changed[k] = cost, back
    return "".join(changed.get(k, part) for k, part in enumerate(parts)), sorted(f"{a}>{b}" for a, b in steps)


def _is_lost(text: str, known: Dictionaries, usual: int | _Usual) -> bool:
    """Whether lost or control characters make the description longer than leaving them out would."""
    return known.length(_lost.sub("", text), usual) + STEP_COST < known.length(text, usual)


def repair(text: str | None, known: Dictionaries) -> Repair | None:
    """None if nothing is wrong with the text, for null and empty ones too."""
    if not text or text.isascii():
        return None
    quoted = []

    def hide(m: re.Match) -> str:
        quoted.append(m.group())
        return f"\x00{len(quoted) - 1}\x01"

    signs = _signs(text)
    work = _quoted.sub(hide, text)
    work = work if signs.isdisjoint(_lines) else _tree.sub(hide, work)
    usual = _Usual(work, known.languages)
    lost = not signs.isdisjoint(_lost_signs) and bool(_lost.search(work)) and _is_lost(work, known, usual)
    chain: list[str] = []
    if any("㐀" <= ch <= "鿿" for ch in signs) and len(_han.findall(work)) > 2:
        back = _from_gbk(work)
        if back is not None:
            if known.length(back.replace("�", ""), usual) + STEP_COST < known.length(work, usual):
                work, lost = back, lost or "�" in back
                chain.append("gbk>utf-8")
    # Every step makes the description shorter, so the chain ends.
    while wide := _wide_count(work):
        best, choice = math.inf, None
        views = _views(work)
        for codec in UTF8_VIEWS:
            if codec in views and (inside := sum(len(m.group()) for m in _runs[codec].finditer(work))):
                back = _from_utf8(work, codec)
                if back != work:
                    best = known.length(work, usual) if best == math.inf else best
                    if (cost := known.length(back, usual) + STEP_COST) < best:
                        best, choice = cost, (f"{codec}>utf-8", back, inside)
        if choice is None or choice[2] < 0.5 * wide:
            # Much is left that UTF-8 does not explain: perhaps it was never UTF-8.
            back, steps = _singles(work, known, usual)
            if steps and (choice is None or known.length(back, usual) + STEP_COST < best):
                work = back
                chain += steps
                break
        if choice is None:
            break
        chain.append(choice[0])
        work = choice[1]
        usual = _Usual(work, known.languages)
    if not chain and not lost:
        return None
    restored = re.sub(r"\x00(\d+)\x01", lambda m: quoted[int(m.group(1))], work)
    return Repair(restored, chain, bool(_lost.search(restored)))


def _sound_counted(texts: DataFrame, usual: set[str]) -> DataFrame:
    """The sound texts (k, t), and rows (f, n) with the counts of their features and, after a \\x01, their characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scripts, signs = Counter(), Counter(), Counter()

        def counts() -> pa.RecordBatch:
            found = [*_words_only(words).items(), *scripts.items(), *(("\x01" + ch, n) for ch, n in signs.items())]
            for counter in (words, scripts, signs):
                counter.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.string()), pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["k", "t", "f", "n"])

        for batch in batches:
            own = batch.column(1).to_pylist()
            rows = [i for i, t in enumerate(own) if is_sound(t, usual)]
            for i in rows:
                words.update(_words(own[i]))
                if not own[i].isascii():
                    signs.update(_signs(own[i]))
                    scripts.update(_written(own[i]))
            kept = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64())], names=["k", "t", "f", "n"])
            if len(words) > HELD:
                yield counts()
        yield counts()

    return materialize(spread(texts).mapInArrow(run, "k long, t string, f string, n long"))


def _pairs_counted(known: DataFrame, width: int) -> np.ndarray:
    """In how many texts each pair of features is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _together((batch.column(0) for batch in batches), width)
        i, j = np.triu(total).nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "n"])

    together = np.zeros((width, width), np.int64)
    for i, j, n in known.select("at").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        together[i, j] = together[j, i] = n
    return together


def _trained(known: DataFrame, languages: Languages, size: int, part: int) -> dict[int, bytes]:
    """The dictionary of each cluster.

    A cluster's texts are dealt by hash into parts of about `part` bytes, each
    part gives a dictionary, and MERGED of these give one until one is left. What
    is trained on at once is bounded, and the same whatever the partitions.
    """

    @F.arrow_udf("int")
    def nearest(at: pa.Array) -> pa.Array:
        return pa.array(languages.nearest(at), pa.int32())

    rows = known.select(nearest("at").alias("c"), "k", "t")
    totals = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.sum(F.octet_length("t")).alias("n")).collect()}
    if not totals:
        return {}
    sizes, parts = {c: _size(n, size) for c, n in totals.items()}, {c: -(-n // part) for c, n in totals.items()}
    mark = F.xxhash64("k", "t")
    number = F.create_map(*(F.lit(x) for c in parts for x in (c, parts[c])))[F.col("c")]
    dealt = rows.withColumns({"mark": mark, "p": F.pmod(mark, number)}).repartition(sum(parts.values()), "c", "p").sortWithinPartitions("c", "p", "mark", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, at = [], 0, None

        def made() -> Iterator[pa.RecordBatch]:
            if own and (found := _trained_on(own, sizes[at[0]])):
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([found], pa.binary())], names=["c", "p", "data"])

        for batch in batches:
            for c, p, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                # A row that is repeated without end is all in one part.
                if (c, p) != at or held > 4 * part:
                    yield from made()
                    own, held, at = [], 0, (c, p)
                own += _samples([t])
                held += len(t)
        yield from made()

    def merge(group: pa.Table) -> pa.Table:
        c, p = group.column("c")[0].as_py(), group.column("p")[0].as_py() // MERGED
        found = _merged(group.column("data").to_pylist(), sizes[c])
        return pa.table({"c": pa.array([c], pa.int32()), "p": pa.array([p], pa.int64()), "data": pa.array([found], pa.binary())})

    kind, left = "c int, p long, data binary", max(parts.values())
    dictionaries = materialize(dealt.select("c", "p", "t").mapInArrow(run, kind))
    while left > 1:
        dictionaries, left = materialize(dictionaries.groupBy("c", F.floor(F.col("p") / MERGED)).applyInArrow(merge, kind)), -(-left // MERGED)
    return {r["c"]: bytes(r["data"]) for r in dictionaries.orderBy("c").collect()}


def fit_dictionaries(df: DataFrame, text_col: str = "text", key_col: str = "chunk_id", size: int = DICTIONARY_BYTES, part: int = PART_BYTES) -> Dictionaries:
    """Dictionaries from all texts; the same for the same rows, whatever their partitions.

    What comes to the driver is bounded: characters, the pairs of FREQUENT_WORDS
    features, and a dictionary for each cluster.
    """
    texts = df.select(F.xxhash64(df[key_col]).alias("k"), df[text_col].alias("t")).where(F.char_length("t") > 0)
    total, filled = df.agg(F.count(F.lit(1)), F.count_if(F.char_length(df[text_col]) > 0)).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = count_characters(t for batch in batches for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["ch", "n"])

    # There are no more rows than characters in Unicode.
    counts = spread(texts.select("t").where(F.col("t").rlike(r"[^\x00-\x7f]"))).mapInArrow(run, "ch string, n long").groupBy("ch").agg(F.sum("n"))
    table = _sound_counted(texts, usual_characters(map(tuple, counts.collect()), filled))
    sound = table.where(F.col("t").isNotNull()).select("k", "t")
    number = sound.count()
    counted = table.where(F.col("f").isNotNull()).groupBy("f").agg(F.sum("n").alias("n"))
    sign, block = F.col("f").startswith("\x01"), F.col("f").startswith("\x00")
    seen = {f[1:]: n for f, n in counted.where(sign).collect()}
    names = [f for f, _ in counted.where(~sign & (F.col("n") >= _least(number))).orderBy(~block, F.desc("n"), "f").limit(FREQUENT_WORDS).collect()]
    features = {f: i for i, f in enumerate(names)}

    @F.arrow_udf("array<int>")
    def at(t: pa.Array) -> pa.Array:
        return pa.array([_known(x, features) for x in t.to_pylist()], pa.list_(pa.int32()))

    known = materialize(sound.select("k", "t", at("t").alias("at")))
    languages = _languages(names, _pairs_counted(known, len(names)), number)
    return _dictionaries(_trained(known, languages, size, part), languages, seen, max(1, total))


def find_garbled(df: DataFrame, dictionaries: Dictionaries, text_col: str = "text", key_col: str = "chunk_id") -> DataFrame:
    """The rows whose text holds characters from a wrong decoding.

    Columns: key, restored string (as far as possible), chain array<string> (the
    steps; empty if characters are lost and nothing could be restored), lost
    boolean (replacement or control characters remain). Null, empty and plain
    ASCII texts are not cases; repeated rows come out each. ASCII texts never
    leave the JVM; there is no shuffle; texts are read whole. The dictionaries
    (a fixed size each) are broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)
    kind = df.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if (r := repair(text, known)) is not None:
                    rows.append(i)
                    found.append(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array([r.text for r in found], pa.string()), pa.array([r.chain for r in found], pa.list_(pa.string())), pa.array([r.lost for r in found], pa.bool_())],
                names=[key_col, "restored", "chain", "lost"],
            )

    return spread(df.select(df[key_col], df[text_col]).where(df[text_col].rlike(r"[^\x00-\x7f]"))).mapInArrow(run, f"`{key_col}` {kind}, restored string, chain array<string>, lost boolean")
