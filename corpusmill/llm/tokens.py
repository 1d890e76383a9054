"""Token ids of whole texts, with words met before taken from tables."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

#: Words kept with their ids in each of a table's two generations.
WORDS_KEPT = 600_000
#: The longest word that is kept, in bytes.
LONGEST_KEPT = 64
#: Words that are encoded in one call.
WORDS_AT_ONCE = 2048
#: What the last id of a word ends with in the vocabulary.
END = "</w>"
#: ASCII marks that may end a word; the tokenizer always parts them from letters.
MARKS = b".,;:!?#*$%&|\"()[]{}<>/-_=+@^~`"


class Recent(dict):
    """A table in two generations: when it is full, what was not used since the last time goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old, self.lacking = most, {}, []

    def __missing__(self, key: bytes) -> None:
        self.lacking.append(key)

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordTokenizer:
    """Ids of a tokenizer that drops white space and ASCII case and never joins what white space separates.

    Its ids for a text are then those of the text's words in a row, so a word is encoded
    once; a word of letters with ASCII marks behind it has the ids of both in a row. Ids are
    held as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = Recent(WORDS_KEPT), Recent(WORDS_KEPT)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(END)]] = True

    def rest(self) -> None:
        """Give up all but the words met last: between tasks a worker holds little."""
        self.words.old, self.parts.old = {}, {}
        self.parts.clear()

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def encode_runs(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that are runs of letters or of marks, so that each has one word end: its last id."""
        out: list[bytes] = []
        for at in range(0, len(parts), WORDS_AT_ONCE):
            some = parts[at : at + WORDS_AT_ONCE]
            ids = np.array(self.ids_of([b" ".join(some).decode()])[0], dtype="<u4")
            ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(ends) == len(some):
                raw, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [raw[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]
            else:
                out += self.encode_any(some)
        return out

    def encode_any(self, words: list[bytes]) -> list[bytes]:
        return [np.array(x, dtype="<u4").tobytes() for x in self.ids_of([w.decode("utf-8", "replace") for w in words])]

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not in the table; short ones are kept."""
        cut: list[tuple[bytes, bytes, bytes]] = []
        whole: list[bytes] = []
        needed: set[bytes] = set()
        for word in new:
            core = word.rstrip(MARKS)
            # Lower case must leave the letters letters, or a mark could join what it brings.
            if core.isalpha() or core and core.decode("utf-8", "replace").lower().isalpha():
                marks = word[len(core) :]
                core = core.lower()
                cut.append((word, core, marks))
                needed.add(core)
                needed.add(marks)
            else:
                whole.append(word)
        known = {b"": b""}
        needed.discard(b"")
        runs = []
        get, old = self.parts.get, self.parts.old.get
        for part in needed:
            ids = get(part) or old(part)
            if ids is None:
                runs.append(part)
            else:
                known[part] = ids
        runs.sort()
        known.update(zip(runs, self.encode_runs(runs), strict=True))
        self.parts.update((p, ids) for p, ids in known.items() if 0 < len(p) <= LONGEST_KEPT)
        self.parts.age()
        learned = {word: known[core] + known[marks] for word, core, marks in cut}
        whole.sort()
        learned.update(zip(whole, self.encode_any(whole), strict=True))
        return learned

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes."""
        split = [t.split() for t in texts]  # bytes: splits at ASCII white space only
        look, lacking, old = self.words.__getitem__, self.words.lacking, self.words.old.get
        found, incomplete = [], []
        for k, words in enumerate(split):
            before = len(lacking)
            found.append(list(map(look, words)))
            if len(lacking) > before:
                incomplete.append(k)
        new = set(lacking)
        lacking.clear()
        back = {w: ids for w in new if (ids := old(w)) is not None}
        learned = self.learn(new.difference(back))
        self.words.update(back)
        self.words.update((w, ids) for w, ids in learned.items() if len(w) <= LONGEST_KEPT)
        fresh = learned | back
        for k in incomplete:
            found[k] = [fresh[w] if x is None else x for w, x in zip(split[k], found[k], strict=True)]
        self.words.age()
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process, which gets one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)
