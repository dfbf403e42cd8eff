"""Text decoded with the wrong character encoding: find it and restore what can be restored.

(1) Over the whole corpus, characters that occur in a good share of the texts are trusted, letters of
alphabets that wrong decoding yields (accented, Greek, Cyrillic) only if they mostly stand beside plain
letters or in a large share of the texts. The mutual information of adjacent trusted pairs is counted.
(2) A pair scores by its mutual information in bits, between bounds, with the sign turned: the more
improbable, the higher; a pair with an untrusted character scores most. (3) Per line, the
maximum-scoring segments are the suspicious runs.
(4) Only inside a run the inverse mappings (encode with the wrong encoding, decode with the right one,
twice at most) are tried; a mapping is accepted if the run turns into usual pairs. A replacement
character is proof of wrong decoding, restorable or not.

Null and empty texts give no rows; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm import codepoints as cp

# Pairs of (encoding wrongly used, right encoding).
SINGLE_BYTE = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-15", "mac-roman", "cp437", "cp850", "cp866", "koi8-r")
NARROW_MAPPINGS = (*((w, "utf-8") for w in SINGLE_BYTE), *((w, "gb18030") for w in SINGLE_BYTE), *((w, "big5") for w in ("cp1252", "latin-1")))
WIDE_MAPPINGS = (
    ("gb18030", "utf-8"), ("big5hkscs", "utf-8"), ("cp932", "utf-8"), ("cp949", "utf-8"), ("cp950", "gb18030"), ("big5hkscs", "gb18030"),
    ("cp932", "gb18030"), ("cp949", "gb18030"), ("gb18030", "big5hkscs"), ("gb18030", "cp932"), ("gb18030", "cp949"),
)
REPLACEMENT = "�"
NARROW_RUN = re.compile("[\x20-\u245f\u2500-\u2e7f]+")  # characters that single-byte encodings yield
#: Least share of the texts that hold a character, for it to be trusted.
TRUSTED_SHARE = 0.025
#: Letters of alphabets that wrong decoding yields must stand beside plain letters so often (of both sides), or be in this share of the texts.
SUSPECT = (0x80, 0x530)
PLAIN_SIDES, DOMINANT_SHARE = 0.6, 0.25
LEAST_RUN_SCORE = 4.0
#: Score of a pair with an untrusted character, and the bounds of scores by mutual information.
UNTRUSTED, RARE, USUAL = 2.0, 1.0, -1.0


def _encoders() -> dict[str, dict[str, int]]:
    """Single-byte encodings as character tables; bytes they leave undefined pass through as control characters."""
    out = {}
    for name in SINGLE_BYTE:
        t: dict[str, int] = {}
        for b in range(256):
            try:
                t[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                t[chr(b)] = b
        out[name] = t
    return out


def _encode(s: str, wrong: str, tables: dict[str, dict[str, int]]) -> bytes | None:
    try:
        if wrong in tables:
            return bytes([tables[wrong][c] for c in s])
        return s.encode(wrong)
    except (KeyError, UnicodeEncodeError):
        return None


class Model:
    """The pair scores of a corpus, and what follows from them for a line."""

    def __init__(self, score: np.ndarray, trusted: np.ndarray):
        self.score, self.trusted, self.tables = score, trusted, _encoders()
        self.known, self.usual = set(np.flatnonzero(trusted).tolist()), (score < 0).tobytes()

    def pair_scores(self, codes: np.ndarray) -> np.ndarray:
        a, b = codes[:-1], codes[1:]
        both = self.trusted[a] & self.trusted[b]
        s = np.where(both, self.score[cp.pair_bucket(a, b)], np.float32(UNTRUSTED))
        s[(a < 128) & (b < 128)] = -0.25
        s[(a == cp.BREAK) | (b == cp.BREAK)] = 0
        s[(a == 0xFFFD) | (b == 0xFFFD)] = UNTRUSTED
        return s

    def usual_share(self, s: str) -> float:
        """Share of usual pairs of trusted characters among the pairs that aren't plain ASCII; of a single character, whether it is trusted."""
        codes = list(map(ord, s))
        if len(codes) == 1:
            return float(codes[0] >= 128 and codes[0] in self.known)
        wide = usual = 0
        known, usual_buckets = self.known, self.usual
        for a, b in zip(codes, codes[1:]):
            if a >= 128 or b >= 128:
                wide += 1
                if a in known and b in known:
                    h = (a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF
                    usual += usual_buckets[((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - cp.PAIR_BUCKETS.bit_length() + 1)]
        return usual / wide if wide else 0.0

    def runs(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Disjoint maximum-scoring segments (as ranges of pairs) of at least ``LEAST_RUN_SCORE``, from left to right."""
        out, total, best, start, end = [], 0.0, 0.0, 0, 0
        for i, s in enumerate(scores.tolist()):
            if total <= 0:
                if best >= LEAST_RUN_SCORE:
                    out.append((start, end))
                total, best, start = 0.0, 0.0, i
            total += s
            if total > best:
                best, end = total, i + 1
            elif best >= LEAST_RUN_SCORE and total < best - 6:
                out.append((start, end))
                total, best = 0.0, 0.0
        if best >= LEAST_RUN_SCORE:
            out.append((start, end))
        return out

    def inverse(self, run: str, depth: int = 2) -> str | None:
        """The run under the mapping that makes most of its pairs usual, or null if none does.

        Bytes that form well-built multi-byte characters are evidence of their own; mappings between
        two double-byte encodings nearly always succeed and need a run of four characters or more.
        """
        body = run.replace(REPLACEMENT, "")
        if not body or body.isascii():
            return None
        wide = any(c >= "\u2e80" for c in body)
        before = self.usual_share(run)
        best, found = max(0.4, before + 0.25), None
        for wrong, right in WIDE_MAPPINGS if wide else NARROW_MAPPINGS:
            raw = _encode(body, wrong, self.tables)
            if raw is None or raw.isascii():
                continue
            bonus = 0.0
            try:
                text = raw.decode(right)
                bonus = 0.3 if right == "utf-8" and len(raw) - len(text) >= 2 else 0.0
                if right == "utf-8" and wrong in ("cp1252", "latin-1") and ("Ã" in body or "Â" in body):
                    bonus = 0.45  # accented letters: two bytes of which the first is telling
            except UnicodeDecodeError:
                text = raw.decode(right, "ignore")
                if not text or len(text.encode(right, "ignore")) < 0.6 * len(raw):
                    continue
                bonus = -0.1
            if wide and (len(text) < 3 and right == "utf-8" or right != "utf-8" and sum(c >= "\x80" for c in body) < 4):
                continue
            if any("\u0530" <= c < "\u2000" and ord(c) not in self.known for c in text):
                continue  # letters of a script that the corpus doesn't use
            if any(c < " " and c != "\t" or "\x7f" <= c < "\xa0" or "\ue000" <= c <= "\uf8ff" for c in text) and (wide or right != "utf-8"):
                bonus -= 0.2
            if depth > 1 and right == "utf-8" and bonus > 0 and max(text) < "\u2300":
                text = self.inverse(text, depth - 1) or text
            after = self.usual_share(text) + bonus
            if after > best:
                best, found = after, text
        return found

    def restore_line(self, line: str, scores: np.ndarray) -> tuple[str, bool]:
        """The line with its garbled runs restored, and whether it was garbled at all."""
        garbled, out, at = REPLACEMENT in line, [], 0
        for a, b in self.runs(scores):
            start, stop = max(a, at), min(b + 1, len(line))
            lo, hi = self._trim(line, start, stop)
            if lo >= hi:
                continue
            narrow = [(lo + m.start(), lo + m.end()) for m in NARROW_RUN.finditer(line[lo:hi]) if not m[0].isascii()]
            # the run without and with the ASCII at its end, its parts of one kind, and the run without a character at either end, which may belong to the text around it
            for x, y in dict.fromkeys(((lo, hi), *narrow, (lo, stop), (start, hi), (lo + 1, hi), (lo + 1, stop), (lo, hi - 1), (lo + 1, hi - 1))):
                if at <= x < y and (text := self.inverse(line[x:y])) is not None:
                    out += [line[at:x], text]
                    at, garbled = y, True
                    if (x, y) not in narrow:
                        break
        return "".join([*out, line[at:]]), garbled

    @staticmethod
    def _trim(line: str, lo: int, hi: int) -> tuple[int, int]:
        """A run without the ASCII at its ends."""
        while lo < hi and line[lo] < "\x80":
            lo += 1
        while hi > lo and line[hi - 1] < "\x80":
            hi -= 1
        return lo, hi


def fit(texts: DataFrame, text: str = "text", trusted_share: float = TRUSTED_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Pair scores (one byte-sized float per bucket) and trusted characters of a whole corpus."""
    shares, plain = cp.character_shares(texts, text, SUSPECT)
    trusted = np.zeros(0x110000, bool)
    for c, share in shares.items():
        strange = SUSPECT[0] <= ord(c) < SUSPECT[1] and c != "·" and plain.get(c, 0.0) < PLAIN_SIDES and share < DOMINANT_SHARE
        trusted[ord(c)] = share >= trusted_share and c != REPLACEMENT and not strange
    pairs, chars = cp.pair_counts(texts, text, trusted)
    score = np.full(cp.PAIR_BUCKETS, RARE, np.float16)
    known, n = np.flatnonzero(trusted & (chars > 0)), max(1, int(pairs.sum()))
    for a in known:  # a row of pairs at a time; the alphabet is bounded by the share a character must reach
        bucket = cp.pair_bucket(np.full(len(known), a), known)
        mutual = np.log2((pairs[bucket] + 1e-3) * n / (float(chars[a]) * chars[known]))
        score[bucket] = np.minimum(score[bucket], np.clip(-mutual, USUAL, RARE))  # of pairs that share a bucket, the more usual one
    return score, trusted


def affected(df: DataFrame, key: str, text: str, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """Distinct (keep..., key) of the garbled records."""
    return restore(df, key, text, model, keep).select(*keep, key).distinct()


def restore(df: DataFrame, key: str, text: str, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """Rows (keep..., key, n_garbled, restored) of the records with at least one garbled line."""
    score, trusted = df.sparkSession.sparkContext.broadcast(model[0]), df.sparkSession.sparkContext.broadcast(np.packbits(model[1]))
    names = [*keep, key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(score.value.astype(np.float32), np.unpackbits(trusted.value)[:0x110000].astype(bool))
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            hit, counts, restored = [], [], []
            full = [(t or "").replace(chr(cp.BREAK), " ") for t in texts]
            if not full:
                continue
            codes = cp.code_points(full)
            scores = m.pair_scores(codes)
            ends = np.flatnonzero((codes == 10) | (codes == cp.BREAK))  # of the lines
            starts = np.concatenate([[0], ends[:-1] + 1])
            row = np.cumsum(codes[ends] == cp.BREAK) - (codes[ends] == cp.BREAK)
            first = np.searchsorted(row, np.arange(len(full)))
            gained = np.concatenate([[0], np.cumsum(np.maximum(scores, 0))])
            lost = np.concatenate([[0], np.cumsum(codes == 0xFFFD)])
            inner = np.maximum(ends - 1, starts)
            suspect = np.flatnonzero((gained[np.minimum(inner, len(gained) - 1)] - gained[starts] >= LEAST_RUN_SCORE) | (lost[ends] > lost[starts]))
            changed: dict[int, list[tuple[int, str]]] = {}
            for k in suspect.tolist():
                a, b, r = int(starts[k]), int(ends[k]), int(row[k])
                line = codes[a:b].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                fixed, garbled = m.restore_line(line, scores[a : max(a, b - 1)])
                if garbled:
                    changed.setdefault(r, []).append((k - int(first[r]), fixed))
            for r, fixes in changed.items():
                lines = full[r].split("\n")
                for at, line in fixes:
                    lines[at] = line
                hit.append(r)
                counts.append(len(fixes))
                restored.append("\n".join(lines))
            kept = batch.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(j) for j in range(len(names))), pa.array(counts, pa.int32()), pa.array(restored, pa.string())],
                [*names, "n_garbled", "restored"],
            )

    types = dict(df.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", n_garbled int, restored string"
    return df.where(F.col(text).isNotNull()).select(*names, text).mapInArrow(run, schema)
