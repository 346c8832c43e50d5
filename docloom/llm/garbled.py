"""Text that was decoded with the wrong character encoding: finding it and restoring the original.

A hidden Markov model labels the characters of a text. One state is clean text; each other state is a pair of encodings, the
right one and the one the bytes were read with. A state's emission cost of a character is the cost, under a class bigram model
of ordinary text, of what the character turns into when its state's transform is undone: itself in the clean state, the re-read
character in a pair's state. Entering and leaving a pair's state has a cost, so a span is labelled only if undoing the transform
makes the text clearly more ordinary. Plain ASCII costs the same in every state and is left out of the sequences.

All texts of a batch are scored at once with table look-ups: the best gain of a single stretch (the two-state Viterbi score of
each pair) tells which few texts need the full decoding with back pointers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTER, LEAVE, NEVER = 3.8, 2.0, 60.0
#: What an ideograph, and for one-byte encodings a frame or odd sign, costs on top where a transform yields it.
RARE_RESULT = 12.0
#: What a pair of one-byte encodings pays a character, as it can make a letter of anything, and for an everyday sign on top.
ONE_BYTE_COST, SIGN_LOST = 0.3, 4.0
TOP = 0x10000

# Character classes.
(SPACE, LOWER, UPPER, DIGIT, ALOWER, AUPPER, CLOWER, CRARE, CUPPER, CODD, SIGN, GREEK, ODD, BOX, CONTROL, IDEOGRAPH, LOST, OTHER, CUPRARE) = range(19)

# Everyday signs, less usual signs, and the Russian letters by how common they are.
SIGNS = "¿¡¶“”‘’„–—…«»°±·µ²³§№€×Ωµ•→≤≥≈≠√∞∑∂∫∏−"
ODD_SIGNS = "½¼¾©®™¬¦¨ª¤¸¹†‡‰‹›ˆ˜ƒ¢£¥¯´º÷⌐⌠⌡‚˘˙˚˛˝­⁄ˇ◊"
RUSSIAN_COMMON = "оеаинтсрвлкмдпуяызьбг"
RUSSIAN_RARE = "чйхжшюцщэфъё"

#: Nats of one character by class, and what neighbours add.
COST = {SPACE: 2.5, LOWER: 3, UPPER: 4, DIGIT: 3.5, ALOWER: 4.2, AUPPER: 7, CLOWER: 3, CRARE: 5, CUPPER: 5, CODD: 10, SIGN: 6, GREEK: 9, ODD: 9, BOX: 7, CONTROL: 16, IDEOGRAPH: 12, LOST: 12, OTHER: 15, CUPRARE: 7}
LATIN, CYRILLIC = (LOWER, UPPER, ALOWER, AUPPER), (CLOWER, CRARE, CUPPER, CUPRARE, CODD)


def bigram_costs() -> np.ndarray:
    """Cost of a character of the second class after one of the first."""
    table = np.tile(np.array([COST[c] for c in range(19)], float), (19, 1))

    def add(firsts: tuple[int, ...], seconds: tuple[int, ...], extra: float) -> None:
        for a in firsts:
            for b in seconds:
                table[a, b] += extra

    add((LOWER, ALOWER), (UPPER, AUPPER), 4)
    add((CLOWER, CRARE), (CUPPER, CUPRARE), 7)
    add((CUPPER, CUPRARE), (CUPPER, CUPRARE), -2)
    add(LATIN, CYRILLIC, 5)
    add(CYRILLIC, LATIN, 5)
    add(LATIN + CYRILLIC, (GREEK, ODD, BOX), 2.5)
    add((AUPPER, ALOWER, ODD, GREEK, CODD), (SIGN,), 2.5)
    add((GREEK, ODD, BOX), LATIN + CYRILLIC, 2)
    add((ALOWER,), (ALOWER,), 2.5)
    add((AUPPER,), (ALOWER, AUPPER), 2.5)
    add((BOX,), (BOX,), -5)
    add((IDEOGRAPH,), (IDEOGRAPH,), -5)
    add(LATIN + CYRILLIC + (DIGIT,), (IDEOGRAPH,), 3)
    add((IDEOGRAPH,), LATIN + CYRILLIC, 3)
    add((CODD,), (CODD,), 2)
    return table


def class_of(c: str) -> int:
    o = ord(c)
    if o < 128:
        return DIGIT if c.isdigit() else LOWER if c.islower() else UPPER if c.isupper() else SPACE
    if c == "�":
        return LOST
    if c == "\xa0":
        return SPACE
    if c in SIGNS:
        return SIGN
    if c in ODD_SIGNS:
        return ODD
    if 0x80 <= o < 0xA0:
        return CONTROL
    if c in RUSSIAN_COMMON:
        return CLOWER
    if c in RUSSIAN_RARE:
        return CRARE
    if c.lower() in RUSSIAN_COMMON:
        return CUPPER
    if c.lower() in RUSSIAN_RARE:
        return CUPRARE
    if 0x400 <= o < 0x460 or o in (0x490, 0x491):
        return CODD
    if 0xC0 <= o < 0x180:
        return ALOWER if c.islower() else AUPPER
    if 0x386 <= o < 0x3CF:
        return GREEK
    if 0x2500 <= o < 0x25A0:
        return BOX
    if 0x3040 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4:
        return IDEOGRAPH
    return OTHER


# The encodings. UTF-8 read as each of the first; then pairs (right, read as) of one byte a character.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866")
WIDE = ("gbk", "cp932", "big5", "euc_kr")
ONE_BYTE = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp866", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("iso8859_5", "cp1251"), ("mac_cyrillic", "cp1251"), ("iso8859_5", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp437", "cp1252"), ("cp850", "cp1252"))


def upper_half(encoding: str) -> dict[str, int]:
    """Byte of each character that the encoding has for 80 to FF. cp1252's gaps are read as control characters, as browsers do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    if encoding == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def folded_half() -> dict[str, int]:
    """The same for cp1252 text that was lower-cased after it was read: leading bytes C2 to DE come as small letters."""
    out = {c: b for c, b in upper_half("cp1252").items() if b < 0xC0}
    return out | {chr(b + 0x20): b for b in range(0xC2, 0xDF) if b != 0xD7}


@cache
def tables() -> dict:
    """Look-up tables over the basic plane, made once in each Python worker."""
    classes = np.array([class_of(chr(o)) if not 0xD800 <= o < 0xE000 else OTHER for o in range(TOP)], np.int8)
    utf8, single = {}, {}
    for name in READ_AS:
        byte = np.zeros(TOP, np.int16)
        for c, b in upper_half(name).items():
            byte[ord(c)] = b
        utf8[f"utf_8>{name}"] = byte
    byte = np.zeros(TOP, np.int16)
    for c, b in folded_half().items():
        byte[ord(c)] = b
    utf8["utf_8>cp1252 lower"] = byte
    for right, wrong in ONE_BYTE:
        table = np.zeros(TOP, np.int32)
        back = {b: c for c, b in upper_half(right).items()}
        for c, b in upper_half(wrong).items():
            if b in back:
                table[ord(c)] = ord(back[b])
        table[:128] = np.arange(128)
        single[f"{right}>{wrong}"] = table
    return {"classes": classes, "costs": bigram_costs(), "utf8": utf8, "single": single}


def utf8_units(byte: np.ndarray, ascii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length): at each leading byte of a valid sequence the code point and its length, elsewhere 0."""
    n = len(byte)
    pad = np.append(byte, [0, 0, 0]).astype(np.int64)
    b0, b1, b2, b3 = pad[:n], pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3]
    c1, c2, c3 = ((b & 0xC0) == 0x80 for b in (b1, b2, b3))
    two = (b0 >= 0xC2) & (b0 < 0xE0) & c1
    three = (b0 >= 0xE0) & (b0 < 0xF0) & c1 & c2
    four = (b0 >= 0xF0) & (b0 < 0xF5) & c1 & c2 & c3
    code = np.where(two, (b0 & 31) << 6 | (b1 & 63), 0)
    code = np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63), code)
    code = np.where(four, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | (b3 & 63), code)
    low = (three & (code < 0x800)) | (four & (code < 0x10000)) | ((code >= 0xD800) & (code < 0xE000))
    length = np.where(low, 0, two * 2 + three * 3 + four * 4)
    return np.where(length > 0, code, 0), length


def gains(codes: np.ndarray) -> dict[str, np.ndarray]:
    """For each pair of encodings what every character would gain by being undone; -NEVER where it can't be."""
    t = tables()
    small = np.minimum(codes, TOP - 1)
    classes = t["classes"][small]
    before = np.append([SPACE], classes[:-1])
    clean = t["costs"][before, classes]
    plain = codes < 128
    out = {}
    for name, table in t["utf8"].items():
        byte = table[small] * (codes < TOP)
        lead = byte >= 0xC2
        if not lead.any():
            continue
        code, length = utf8_units(byte, plain)
        if not (length > 0).any():
            continue
        inside = np.zeros(len(codes) + 4, np.int8)
        at = np.flatnonzero(length)
        for k in range(1, 4):
            inside[at[length[at] > k] + k] = 1
        inside = inside[: len(codes)].astype(bool) & (length == 0)
        again = np.where(length > 0, t["classes"][np.minimum(code, TOP - 1)], classes)
        again = np.where(code >= TOP, OTHER, again)
        # Trailing bytes pass the class of their character on to what follows.
        again = again[np.maximum.accumulate(np.where(inside, 0, np.arange(len(codes))))]
        cost = t["costs"][np.append([SPACE], again[:-1]), again] + RARE_RESULT * ((again == IDEOGRAPH) | (again == LOST))
        gain = np.where(plain | (length > 0) | inside, clean - np.where(inside, 0.0, cost), -NEVER)
        # A sequence is taken or left as a whole: its characters share its gain.
        unit = np.cumsum(~inside) - 1
        total = np.bincount(unit, gain)
        out[name] = (total / np.bincount(unit))[unit]
    for name, table in t["single"].items():
        other = table[small] * (codes < TOP)
        if not (other >= 128).any():
            continue
        again = t["classes"][other]
        cost = t["costs"][np.append([SPACE], again[:-1]), again]
        drawn = (again == BOX) | (again == ODD) | (again == CONTROL) | (again == OTHER)
        paid = np.where(plain, 0.0, ONE_BYTE_COST + SIGN_LOST * (classes == SIGN) + RARE_RESULT * drawn)
        gain = np.where(other > 0, clean - cost - paid, -NEVER)
        # A run of such characters is taken or left as a whole, with what the ASCII character after it makes of the change.
        follows = plain & np.append([False], ~plain[:-1])
        run = np.cumsum(plain | np.append([True], plain[:-1])) - 1
        total = np.bincount(run, np.where(plain, 0.0, gain))
        total[run[np.flatnonzero(follows) - 1]] += gain[follows]
        out[name] = np.where(plain, 0.0, (total / np.bincount(run))[run])
    return out


WIDE_RUN = re.compile("[぀-ヿ㄀-ㄯ一-鿿가-힣-｡-ﾟ]+[^\x00-\x7f]*")


def wide_gains(text: str, codes: np.ndarray, keep: np.ndarray) -> dict[str, np.ndarray]:
    """The same for UTF-8 that was read as an encoding of two bytes a character; whole runs are undone at once."""
    out = {}
    place = np.full(len(text) + 1, -1, np.int64)
    place[keep] = np.arange(len(keep))
    t = tables()
    for name in WIDE:
        gain = np.where(codes < 128, 0.0, -NEVER)
        found = False
        for m in WIDE_RUN.finditer(text):
            run = m.group().rstrip("�")
            try:
                again = run.encode(name).decode("utf-8", "replace")
            except UnicodeEncodeError:
                continue
            bad = again.rstrip("�").count("�")
            if bad or not again.strip("�"):
                continue
            a, b = m.start(), m.start() + len(run)
            old = [SPACE if a == 0 else class_of(text[a - 1])] + [class_of(c) for c in run]
            new = [old[0]] + [class_of(c) for c in again if c != "�"]
            after = [class_of(text[b])] if b < len(text) else []
            old, new = old + after, new + after
            total = sum(t["costs"][x, y] for x, y in zip(old, old[1:])) - sum(t["costs"][x, y] for x, y in zip(new, new[1:]))
            gain[place[a:b]] = total / len(run)
            found = True
        if found:
            out[f"utf_8>{name}"] = gain
    return out


def viterbi(scores: list[np.ndarray]) -> np.ndarray:
    """States of the best path: 0 clean, k the k-th pair."""
    n, m = len(scores[0]), len(scores) + 1
    emit = np.vstack([np.zeros(n), *scores])
    best, back = np.zeros(m), np.zeros((n, m), np.int8)
    best[1:] = -ENTER
    move = np.full((m, m), -ENTER - LEAVE)
    move[0, 1:], move[1:, 0] = -ENTER, -LEAVE
    np.fill_diagonal(move, 0)
    for i in range(n):
        options = best[:, None] + move if i else np.where(np.eye(m, dtype=bool), best[:, None], -1e18)
        back[i] = options.argmax(0)
        best = options.max(0) + emit[:, i]
    best[1:] -= LEAVE
    state = int(best.argmax())
    path = np.zeros(n, np.int8)
    for i in range(n - 1, -1, -1):
        path[i] = state
        state = back[i, state]
    return path


def undo(name: str, text: str) -> str:
    """The inverse transform of a span."""
    right, wrong = name.split(">")
    half = folded_half() if wrong == "cp1252 lower" else upper_half(wrong) if wrong not in WIDE else {}
    if right == "utf_8" and wrong in WIDE:
        return "".join(x if x.isascii() else x.encode(wrong, "replace").decode("utf-8", "replace") for x in re.split("([^\x00-\x7f]+)", text))
    raw = b"".join(bytes([half[c]]) if c in half else c.encode("ascii", "replace") for c in text)
    again = raw.decode(right, "replace")
    return again.lower() if wrong == "cp1252 lower" else again


def whole_words(text: str, begin: int, end: int, name: str) -> tuple[int, int]:
    """A span of one-byte characters reaches to the ends of its words: every non-ASCII character of them was read the same way."""
    if name.startswith("utf_8"):
        return begin, end
    half = upper_half(name.split(">")[1])
    while begin > 0 and text[begin - 1] in half and not text[begin - 1].isspace():
        begin -= 1
    while end < len(text) and text[end] in half and not text[end].isspace():
        end += 1
    return begin, end


ENTITIES = re.compile(r"(?:&#(?:1[2-9]\d|2[0-4]\d|25[0-5]);){2,}")


def entity_bytes(m: re.Match) -> str:
    """Numeric entities that spell the bytes of UTF-8 characters; any other entities mean what they should."""
    raw = bytes(int(x) for x in re.findall(r"\d+", m.group()))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def compress(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text without the ASCII characters that have ASCII on both sides, and their positions."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes >= 128
    near = high.copy()
    near[1:] |= high[:-1]
    near[:-1] |= high[1:]
    keep = np.flatnonzero(near)
    return codes[keep].astype(np.int64), keep


def stretch(gain: np.ndarray) -> np.ndarray:
    """At each position the best total of a stretch that ends there."""
    total = np.cumsum(gain)
    return total - np.minimum.accumulate(np.append([0.0], total[:-1]))


def label_batch(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans (begin, end, pair) of each text."""
    parts = [compress(t) for t in texts]
    sizes = np.array([len(c) for c, _ in parts])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    # Two blanks between texts, the second one at a price that no stretch can pay.
    flat = np.concatenate([np.append(c, [32, 32]) for c, _ in parts]) if parts else np.zeros(0, np.int64)
    starts = np.cumsum(sizes + 2) - sizes - 2
    fences = starts + sizes + 1
    scored = gains(flat) if len(flat) else {}
    hits: dict[int, list[str]] = {}
    for name, gain in scored.items():
        gain[fences] = -1e6
        best = np.maximum.reduceat(stretch(gain), starts)
        for i in np.flatnonzero(best > ENTER + LEAVE):
            hits.setdefault(int(i), []).append(name)
    for i, text in enumerate(texts):
        codes, keep = parts[i]
        own = {name: scored[name][starts[i] : starts[i] + sizes[i]] for name in hits.get(i, [])}
        if WIDE_RUN.search(text):
            own |= {k: v for k, v in wide_gains(text, codes, keep).items() if len(v) and stretch(v).max() > ENTER + LEAVE}
        if not own:
            continue
        names = list(own)
        path = viterbi([own[k] for k in names])
        at = 0
        while at < len(path):
            end = at
            while end + 1 < len(path) and path[end + 1] == path[at]:
                end += 1
            if path[at]:
                name = names[path[at] - 1]
                begin, stop = whole_words(text, int(keep[at]), int(keep[end]) + 1, name)
                out[i].append((max(begin, out[i][-1][1] if out[i] else 0), stop, name))
            at = end + 1
    return out


def repair_batch(texts: list[str], rounds: int = 3) -> list[tuple[str, list[str], bool]]:
    """(text as far as it can be restored, pairs of encodings that were undone, whether something is lost) of each text."""
    state = [(t, [], False) for t in texts]
    todo = list(range(len(texts)))
    for i, t in enumerate(texts):
        if "&#" in t and (again := ENTITIES.sub(entity_bytes, t)) != t:
            state[i] = (again, ["utf_8>entities"], False)
    for _ in range(rounds):
        changed = []
        for i, spans in zip(todo, label_batch([state[i][0] for i in todo])):
            if not spans:
                continue
            text, names, _ = state[i]
            for a, b, name in reversed(spans):
                text = text[:a] + undo(name, text[a:b]) + text[b:]
            state[i] = (text, names + [n for n in dict.fromkeys(n for *_, n in spans)], False)
            changed.append(i)
        todo = changed
        if not todo:
            break
    return [(text, names, lost(text)) for text, names, _ in state]


def lost(text: str) -> bool:
    """Whether a replacement character stands where a letter or sign was."""
    return "�" in text


def garbled(df: DataFrame, keys: tuple[str, ...] = ("doc_id", "ord"), text: str = "text") -> DataFrame:
    """Rows whose text is garbled in whole or in part: (keys, text, restored, encodings, lost).

    `encodings` lists what was undone as right>read_as, empty if only replacement characters are left; `lost` tells whether
    replacement characters remain in `restored`. Null and pure ASCII texts without numeric entities are never affected. A row
    that repeats a key with the same text counts once. Whole texts are read; only affected rows are shuffled.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("text").rlike(r"[^\x00-\x7f]|&#\d"))
    kinds = [rows.schema[n].dataType.simpleString() for n in names]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 2000):
                part = frame.iloc[begin : begin + 2000]
                fixed = repair_batch(part["text"].tolist())
                take = [i for i, (_, undone, gone) in enumerate(fixed) if undone or gone]
                found = part.iloc[take].copy()
                found["restored"] = [fixed[i][0] for i in take]
                found["encodings"] = [fixed[i][1] for i in take]
                found["lost"] = [fixed[i][2] for i in take]
                yield found

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", text string, restored string, encodings array<string>, lost boolean"
    found = rows.mapInPandas(work, schema).dropDuplicates([*names, "text"])
    return found.withColumnsRenamed(dict(zip(names, keys)))
