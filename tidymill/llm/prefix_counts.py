"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE.

Within one match of the split pattern, the last token of each prefix follows from those of shorter prefixes: of the tokens that end at a byte, exactly
one lets the prefix before it keep its own last token, i.e. no merge would cross the seam between the two. One token more than that
prefix has, is the count. Whether a merge crosses a seam is read off the merges: both sides are taken apart, the later merge first, and a pair that
faces each other across the seam merges if its merge comes before those that swallow either side.

Counts of a text are the sums over its matches. A prefix that ends inside a match splits as the text does, but for two cases: white space that is
not followed by anything is one match to its end, and an apostrophe contraction that lacks its last letter is two matches. An added token of the vocabulary
file parts the text; a prefix that ends inside of one counts it as the characters it is.

The table of a text answers without encoding again: tokens of the whole and of any prefix, whether a limit is passed, the longest prefix
within a budget. Counts can fall when a prefix grows, so the longest prefix is looked for in the whole table.

Defined results: a null text counts as empty, which has no tokens; offsets out of range are moved to the nearest end, null ones stay null; repeated rows stay
repeated; an empty table gives no rows; columns not named in `keep` are not read, so none can clash. A text's table takes four bytes a code point.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .frames import map_batches, pick, remembered, whole_text

#: Matches whose tables a worker remembers, and the longest of them; longer ones are kept as wide numbers and not remembered.
REMEMBERED, SHORT = 400_000, 63
#: Pairs of tokens of which a worker remembers whether a merge crosses them.
REMEMBERED_PAIRS = 1 << 18
#: The split pattern of the vocabulary files (a fixed value), with white space as the library takes it.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SPACES = regex.compile(r"\p{White_Space}{2,}(?=\P{White_Space})")
CONTRACTIONS = {"'re", "'ve", "'ll"}
#: Code points whose class does not depend on the Unicode version; texts with others are split by the library.
UNSURE = regex.compile(r"[^\x00-՗‐-⁯぀-ゖ゠-ヿ一-龥]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Prefixes:
    def __init__(self, json_path: str):
        with open(json_path, encoding="utf-8") as file:
            held = json.load(file)
        letters, model = _byte_letters(), held["model"]
        self.library_split = Tokenizer.from_file(json_path).pre_tokenizer.pre_tokenize_str
        number = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        #: Time at which a token comes to be: its merge's place, bytes before all.
        self.born, self.halves, self.made = {i: -1 for token, i in number.items() if len(token) == 1}, {}, {}
        texts = {i: token for token, i in number.items()}
        for time, pair in enumerate(model["merges"]):
            a, b = (number[bytes(letters[c] for c in part)] for part in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = number[texts[a] + texts[b]]
            self.made[a, b] = time
            if whole not in self.born:
                self.born[whole], self.halves[whole] = time, (a, b)
        # A token whose halves would not be left to meet never comes up.
        reached = {i for i, time in self.born.items() if time < 0}
        for whole, (a, b) in self.halves.items():
            if a in reached and b in reached and self._kept_apart(a, b, self.born[whole]):
                reached.add(whole)
        #: All ends of tokens, with the token if it is a whole one: where no end goes further back, no token does.
        self.ends = {texts[i][k:]: -1 for i in reached for k in range(1, len(texts[i]))} | {texts[i]: i for i in reached}
        self.stays = lru_cache(maxsize=REMEMBERED_PAIRS)(lambda a, b: self._kept_apart(a, b, len(self.made)))
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in held["added_tokens"]):
            raise ValueError("an added token that is not matched as it stands")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tables: dict[str, bytes] = {}

    def _kept_apart(self, a: int, b: int, until: int) -> bool:
        """No merge earlier than `until` crosses the seam between a and b."""
        dies_a = dies_b = until     # when the facing tokens are swallowed by larger ones
        while True:
            time = self.made.get((a, b))
            # At equal times the leftmost pair merges first: that left of the seam before the one across it, which goes before that right of it.
            if time is not None and time < dies_a and (time <= dies_b if dies_b < until else time < dies_b):
                return False
            if self.born[a] < 0 and self.born[b] < 0:
                return True
            # Right of the seam, the later step is undone first; where both are the same merge, that on the right was the later one.
            if self.born[b] >= self.born[a]:
                dies_b, b = self.born[b], self.halves[b][0]
            else:
                dies_a, a = self.born[a], self.halves[a][1]

    def of_bytes(self, data: bytes, held: tuple[bytes, list[int], list[int]] | None = None) -> tuple[bytes, list[int], list[int]]:
        """The bytes of one match, token counts of the prefixes of 0, 1, 2 ... of them, and their last tokens. What was held for another match serves as far as both begin alike, and is used up."""
        before, counts, last = held or (b"", [0], [-1])
        same, most = 0, min(len(before), len(data))
        while same < most and before[same] == data[same]:
            same += 1
        del counts[same + 1:], last[same + 1:]
        known, stays = self.ends.get, self.stays
        for end in range(same + 1, len(data) + 1):
            fitting, start = [], end - 1
            while start >= 0 and (token := known(data[start:end])) is not None:
                if token >= 0:
                    fitting.append((start, token))
                start -= 1
            while fitting:      # the longest first
                start, token = fitting.pop()
                if start == 0 or stays(last[start], token):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise AssertionError("a byte at which no token ends")
        return data, counts, last

    @staticmethod
    def _of_characters(match: str, data: bytes, counts: list[int]) -> list[int]:
        """Token counts of the prefixes of 1, 2 ... code points of one match."""
        if match in CONTRACTIONS:
            return [1, 2, counts[3]]    # an apostrophe and a letter are two matches of one byte each
        if len(data) == len(match):
            return counts[1:]
        return [n for n, byte in zip(counts[1:-1], data[1:]) if byte & 0xC0 != 0x80] + counts[-1:]

    def of_match(self, match: str) -> list[int]:
        data = match.encode()
        return self._of_characters(match, data, self.of_bytes(data)[1])

    def split(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.library_split(text)]
        return SPLIT.findall(text)

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """Tables of the short matches, one byte a code point; those that are new in sorted order, so that each goes on from where it leaves the one before."""
        found = {m: t for m in matches if (t := self.tables.get(m)) is not None}
        held = None
        for data, match in sorted((m.encode(), m) for m in matches if m not in found and len(m) <= SHORT):
            held = self.of_bytes(data, held)
            found[match] = bytes(self._of_characters(match, data, held[1]))
            if len(self.tables) < REMEMBERED:
                self.tables[match] = found[match]
        return found

    def _ordinary(self, text: str, matches: list[str], tables: dict[str, bytes]) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, 2 ... code points of a text without added tokens."""
        if not text:
            return np.zeros(1, dtype=np.uint32)
        sizes = np.fromiter(map(len, matches), dtype=np.int64, count=len(matches))
        if sizes.max() <= SHORT:    # at most four bytes a code point, so counts fit into one byte
            inner = np.frombuffer(b"".join(map(tables.__getitem__, matches)), dtype=np.uint8)
        else:
            inner = np.concatenate([np.array(list(tables[m]) if len(m) <= SHORT else self.of_match(m), dtype=np.uint32) for m in matches])
        ends = np.cumsum(sizes)
        totals = inner[ends - 1].astype(np.int64)
        counts = np.zeros(len(text) + 1, dtype=np.uint32)
        counts[1:] = inner + np.repeat(np.cumsum(totals) - totals, sizes)
        for run in SPACES.finditer(text):
            counts[run.end()] = counts[run.start()] + self.of_match(run[0])[-1]
        return counts

    def _parted(self, text: str) -> tuple[list[str], list[int]]:
        """Stretches of ordinary text, each with the added token behind it less its last character, and the places where those tokens begin in them."""
        if self.parts is None or not any(token in text for token in self.added):
            return [text], [len(text)]
        pieces = self.parts.split(text)
        return [pieces[k] + "".join(pieces[k + 1:k + 2])[:-1] for k in range(0, len(pieces), 2)], [len(p) for p in pieces[::2]]

    def counts_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token counts of the prefixes of 0, 1, 2 ... code points of each text."""
        parted = [self._parted(t) for t in texts]
        split = [[self.split(s) for s in stretches] for stretches, _ in parted]
        tables = self.learn(set(chain.from_iterable(m for matches in split for m in matches)))
        for (stretches, sizes), matches in zip(parted, split, strict=True):
            found, base = [], 0
            for k, stretch in enumerate(stretches):
                inner = self._ordinary(stretch, matches[k], tables)
                found.append(base + inner)
                base += int(inner[sizes[k]]) + 1
            yield found[0] if len(found) == 1 else np.concatenate(found).astype(np.uint32)

    def counts(self, text: str) -> np.ndarray:
        return next(self.counts_of([text]))


def prefixes(json_path: str) -> Prefixes:
    return remembered(("prefix counts", json_path), lambda: Prefixes(json_path))


def longest_within(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most so many tokens."""
    return int(np.flatnonzero(counts <= limit)[-1]) if limit >= 0 else 0


def count(df: DataFrame, json_path: str, limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes long, n_tokens long, over_limit boolean, fit_chars long: code points of the longest prefix within the limit."""
    def run(rows):
        found = [(int(c[-1]), longest_within(c, limit)) for c in prefixes(json_path).counts_of(rows["_text"])]
        n = [x for x, _ in found]
        return {c: rows[c] for c in keep} | {"n_bytes": rows["_size"], "n_tokens": n, "over_limit": [x > limit for x in n], "fit_chars": [fit for _, fit in found]}

    source = pick(df, *dict.fromkeys((*keep, "text")))
    kept = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    asked = source.select(*keep, whole_text().alias("_text"), F.octet_length(whole_text()).cast("long").alias("_size"))
    return map_batches(asked, run, kept + "n_bytes long, n_tokens long, over_limit boolean, fit_chars long", rows=128)


def budget(df: DataFrame, json_path: str, offsets: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, tokens array<long>: of the prefixes that end at the code points in the array column `offsets`."""
    def run(rows):
        found = []
        for text, asked, counts in zip(rows["_text"], rows["_offsets"], prefixes(json_path).counts_of(rows["_text"]), strict=True):
            found.append(None if asked is None else [None if i is None else int(counts[min(max(i, 0), len(text))]) for i in asked])
        return {c: rows[c] for c in keep} | {"tokens": found}

    source = pick(df, *dict.fromkeys((*keep, "text", offsets)))
    kept = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(source.select(*keep, whole_text().alias("_text"), F.col(offsets).cast("array<long>").alias("_offsets")), run, kept + "tokens array<long>", rows=128)


def truncate(df: DataFrame, json_path: str, limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text string: its longest prefix within the limit; n_tokens long: tokens of that prefix."""
    def run(rows):
        found = []
        for text, counts in zip(rows["_text"], prefixes(json_path).counts_of(rows["_text"]), strict=True):
            size = longest_within(counts, limit)
            found.append((text[:size], int(counts[size])))
        return {c: rows[c] for c in keep} | {"text": [t for t, _ in found], "n_tokens": [n for _, n in found]}

    keep = tuple(c for c in keep if c != "text")
    source = pick(df, *dict.fromkeys((*keep, "text")))
    kept = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(source.select(*keep, whole_text().alias("_text")), run, kept + "text string, n_tokens long", rows=128)
