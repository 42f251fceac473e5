"""What the operators of this package share: Arrow row maps and the byte-pair encoder's cache."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as keep it from clashing with a column of ``df``, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain types and arrays of them."""
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        inner = re.fullmatch(r"array<(\w+)>", kind)
        fields.append(pa.field(name, pa.list_(_TYPES[inner[1]]) if inner else _TYPES[kind]))
    return pa.schema(fields)


def map_rows(df: DataFrame, start: Callable[[], Callable[..., list[tuple]]], ddl: str) -> DataFrame:
    """For each row, the rows that ``start()(*values)`` returns; ``start`` runs once a task and holds its caches.

    Rows go through Arrow in batches, one text at a time in Python.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                out += each(*(c[i].as_py() for c in columns))
            cells = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def add_columns(df: DataFrame, column: str, start: Callable[[], Callable], ddl: str) -> DataFrame:
    """``df`` with the columns of ``ddl`` that ``start()(value)`` gives for ``column``; every other column passes through as it is."""
    from pyspark.sql.types import StructType

    added = arrow_schema(ddl)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            text = batch.column(at)
            cells = list(zip(*(each(text[i].as_py()) for i in range(batch.num_rows)))) or [()] * len(added)
            arrays = [*batch.columns, *(pa.array(c, f.type) for c, f in zip(cells, added))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields]))


class EncodedWords(dict):
    """word -> its ids as little-endian 32-bit bytes, behind a lead text; at most ``most`` words are kept."""

    def __init__(self, encode: Callable[[str], bytes], lead: str, most: int):
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.lead + word)
        if len(self) < self.most:
            self[word] = ids
        return ids


#: White space other than the space and the line feed, in any sense that a tokenizer's pattern may give it.
ODD_SPACES = ["\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"]
RUNS = ["  ", " \n", "\n ", "\n\n"]


class ByteBpe:
    """Whole texts to ids (as little-endian 32-bit bytes) with a byte-level BPE whose pre-tokens never span a word.

    A lone space or line feed between other characters always starts a pre-token, so a text with no longer run of white
    space is encoded word by word from a cache; any other text goes to the library whole. Ids are the library's either way.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = 600_000):
        self.encode = encode
        self.first = EncodedWords(encode, "", most // 6)
        self.rest = EncodedWords(encode, " ", most)
        self.line = encode("\n")

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in RUNS) or any(x in text for x in ODD_SPACES):
            return self.encode(text)
        first, rest = self.first, self.rest.__getitem__
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]] + b"".join(map(rest, words[1:])))
        return self.line.join(out)


def byte_ranks(path: str) -> dict[bytes, int]:
    """token -> id from a ``.tiktoken`` rank file, or from the vocabulary of a byte-level ``.json`` tokenizer whose ids are its ranks."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {x["content"] for x in held["added_tokens"]}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte[c] for c in token): rank for token, rank in held["model"]["vocab"].items() if token not in special}


def library_encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian 32-bit bytes; strings of special tokens are ordinary text."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens={}).encode_ordinary

    def encode(text: str) -> bytes:
        ids = own(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


def file_encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """text -> the ids that the tokenizers library gives for a ``.json`` tokenizer with add_special_tokens=False, as little-endian 32-bit bytes.

    The library takes an added token's content inside a text for that token, so a text that holds one goes to the library
    whole; any other is encoded by cached words.
    """
    from tokenizers import Tokenizer

    own, plain = Tokenizer.from_file(path), ByteBpe(library_encoder(path, pattern))
    added = [token.content for token in own.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if not any(x in text for x in added):
            return plain(text)
        ids = own.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode
