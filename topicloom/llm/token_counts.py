"""Edit-aware token counts: a segment tree of pre-token pieces per document, updated where edits touch it.

``Tree`` holds a text as pieces that end at safe boundaries of the split
pattern (see bpe.safe_parts), each with its number of tokens, under a binary
tree of sums. An edit replaces a range of characters. Only the pieces that it
touches are encoded again, with one piece of context to either side, as an
edit can join or part the matches at its borders; the sums above them are
renewed. Counts equal those of encoding the whole edited text.

``count_after_edits`` builds the tree of every document in one pass without a
shuffle, applies the document's edits in order and returns both counts.

Defined results: null text counts as empty; edits are (start, end, text) in
characters of the text as it then is, clipped to it, null bounds count as its
end and null texts as empty; no edits give equal counts; rows repeat as they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _SAFE, encode_text, encoder, read_ranks
from .common import map_arrow, quoted, session, ship_code

#: Pieces have about so many characters, more where no safe boundary is there.
PIECE = 512


def pieces(text: str, size: int = PIECE) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class Tree:
    """A text's pieces in leaves, with sums of characters and tokens; ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str, count):
        self.count, self.encoded = count, 0
        self._build([(p, self._tokens(p)) for p in pieces(text)])

    def _tokens(self, piece: str) -> int:
        self.encoded += len(piece)
        return self.count(piece)

    def _build(self, leaves):
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.leaves = leaves
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (p, n) in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(p), n
        for i in range(self.size - 1, 0, -1):
            self._renew(i)

    def _renew(self, i):
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one at the end), and the character's place in it."""
        at, i = min(at, self.n_chars), 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:  # an empty right half holds nothing
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def edit(self, start: int | None, end: int | None, new: str | None):
        """Replace characters ``start`` to ``end`` by ``new``."""
        n = self.n_chars
        start = n if start is None else min(max(start, 0), n)
        end = n if end is None else min(max(end, start), n)
        a, at = self.find(start)
        b, to = self.find(end)
        low, high = max(0, a - 1), min(len(self.leaves) - 1, b + 1)  # one piece of context each side
        before = "".join(p for p, _ in self.leaves[low:a]) + self.leaves[a][0][:at]
        after = self.leaves[b][0][to:] + "".join(p for p, _ in self.leaves[b + 1 : high + 1])
        made = [(p, self._tokens(p)) for p in pieces(before + (new or "") + after)]
        # the context's outer ends are boundaries of the old text; they are safe in the new one only
        # if the characters on both sides of them still are what made them so
        while low > 0 and not self._joins(self.leaves[low - 1][0], made[0][0]):
            low -= 1
            made = [(p, self._tokens(p)) for p in pieces(self.leaves[low][0] + "".join(p for p, _ in made))]
        while high < len(self.leaves) - 1 and not self._joins(made[-1][0], self.leaves[high + 1][0]):
            high += 1
            made = [(p, self._tokens(p)) for p in pieces("".join(p for p, _ in made) + self.leaves[high][0])]
        if len(made) == high - low + 1:
            for i, leaf in enumerate(made, low):
                self.leaves[i] = leaf
                j = self.size + i
                self.chars[j], self.tokens[j] = len(leaf[0]), leaf[1]
                while j > 1:
                    j //= 2
                    self._renew(j)
        else:  # leaves shift: sums are renewed, nothing is encoded
            self._build(self.leaves[:low] + made + self.leaves[high + 1 :])

    @staticmethod
    def _joins(left: str, right: str) -> bool:
        """Whether the border of two pieces is a safe boundary."""
        return bool(left and right and _SAFE.match(left[-1] + right[0], 1))

    def text(self) -> str:
        return "".join(p for p, _ in self.leaves)


def count_after_edits(df: DataFrame, rank_path: str, pattern: str, *, text_col: str = "text", edits_col: str | None = "edits") -> DataFrame:
    """All other columns and ``n_tokens``, ``n_tokens_edited``, ``n_chars_edited``, ``n_chars_encoded`` (for the edits alone) and ``edited_sha256``."""
    spark = session(df)
    ship_code(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    new = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded")] + [T.StructField("edited_sha256", T.StringType())]
    names = {f.name for f in new} | {text_col, edits_col}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + new)

    def run(batches):
        import hashlib

        import pyarrow as pa

        enc = encoder(ranks.value, pattern)
        count = lambda p: len(encode_text(p, enc, pattern)) if p else 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            edits = batch.column(batch.schema.get_field_index(edits_col)).to_pylist() if edits_col else [None] * len(texts)
            rows = []
            for text, todo in zip(texts, edits):
                tree = Tree(text or "", count)
                first, done = tree.n_tokens, tree.encoded
                for e in todo or []:
                    if e is not None:
                        tree.edit(*e.values())
                rows.append((first, tree.n_tokens, tree.n_chars, tree.encoded - done, hashlib.sha256(tree.text().encode("utf-8", "replace")).hexdigest()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(columns)], names=[*kept, *[f.name for f in new]])

    return map_arrow(df.select(*map(quoted, [*kept, text_col, *([edits_col] if edits_col else [])])), run, schema)
