"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked as the model's normaliser does it (a space becomes the mark, one stands before the text) and cut before each run of
marks. No piece has a mark after another character, so the best segmentation of a text is that of its marked words one by one. The
distinct marked words of a block are sorted, which is the depth-first order of their trie: a word keeps the forward scores of the
prefix it shares with the one before and goes on from there. A forward score is the best sum of piece scores up to a character; of
equal sums the one with the longest last piece stays. Characters without a piece cost the least score less 10 and are written as bytes.

Words done are kept, up to MEMO of them, for the next block of the task. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from varspark.llm.common import as_bytes, in_blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO = 600_000
DECODED = 1 << 18
UNITS = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """Pieces, scores and bytes of a model, as plain tables."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        usual = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.of = {model.id_to_piece(i): (model.get_score(i), i) for i in usual}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown, self.unknown_score = model.unk_id(), min((s for s, _ in self.of.values()), default=0.0) - 10
        #: every beginning of a piece: what the search goes on through; with the score and id of those that are pieces
        self.beginnings = {p[:k]: (0.0, -1) for p in self.of for k in range(1, len(p))} | self.of
        self.written = [b""] * len(ids)
        for i in usual:
            self.written[i] = model.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.written[i] = bytes([b])
        self.written[self.unknown] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.of):
            raise ValueError("a piece of this model goes on after a mark; marked words would not be independent")

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """ids (int32 bytes) of each of the sorted distinct words."""
        beginnings, unknown_score, out = self.beginnings, self.unknown_score, {}
        score, last, alive, before = [0.0], [(0, 0)], [[]], ""
        for word in words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del score[same + 1 :], last[same + 1 :], alive[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best, link, on = -1e30, None, []
                for start in (*alive[-1], end - 1):
                    piece = beginnings.get(word[start:end])
                    if piece is not None:
                        on.append(start)
                        if piece[1] >= 0 and score[start] + piece[0] > best:
                            best, link = score[start] + piece[0], (start, piece[1])
                if word[end - 1] not in self.of and score[end - 1] + unknown_score > best:
                    best, link = score[end - 1] + unknown_score, (end - 1, -1)
                score.append(best)
                last.append(link)
                alive.append(on)
            ids, at = [], len(word)
            while at:
                start, piece = last[at]
                ids += [piece] if piece >= 0 else self.fallback(word[start:at])[::-1]
                at = start
            out[word] = np.array(ids[::-1], np.int32).tobytes()
            before = word
        return out

    def decode(self, ids: list[int]) -> bytes:
        text = b"".join(map(self.written.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces, self.memo = pieces, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        memo = self.memo
        self.memo.update(self.pieces.encode_words(sorted(set().union(*units).difference(memo)) if units else []))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, u)), np.int32) for u in units]
        if len(memo) > MEMO:
            memo.clear()
        return out


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """docs with the piece ids of each text as array<int>. A column named as `ids` is replaced. Null and empty texts have no ids.
    Texts of any length are encoded as wholes; rows alike get the same ids."""
    docs = docs.drop(ids)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    at = docs.columns.index(text)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in in_blocks(batches, text):
            found = encoder.encode([t.decode("utf-8", "replace") for t in as_bytes(batch.column(at))])
            cut = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cut, pa.array(np.concatenate(found)))], [*batch.schema.names, ids])

    return docs.mapInArrow(block, StructType([*docs.schema, StructField(ids, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """docs with the text of the ids. A column named as `text` is replaced. Null or no ids give an empty text.

    Rows are taken DECODED ids at a time, a longer one alone. A text with the mark itself comes back with a space in its place; every other text comes back as it was.
    """
    docs = docs.drop(text)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    at = docs.columns.index(ids)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, first = batch.column(at), 0
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            for last in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // DECODED)) + 1), batch.num_rows]:
                if last > first:
                    part = batch.slice(first, last - first)
                    texts = [shared.value.decode(x or []).decode("utf-8", "replace") for x in part.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])
                first = last

    return docs.mapInArrow(block, StructType([*docs.schema, StructField(text, StringType())]))
