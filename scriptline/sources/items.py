"""Items of XML files put together from their tags, in the order in which Spark reads them, without moving them.

A task looks at the tags of a block in Arrow batches and holds the item that is open. What a block cannot know alone comes
out as parts: the fields before its first item (they belong to an item of an earlier block), its last item (which may go
on in a later block), items whose group was opened in an earlier block, and the group that is open at its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Kinds of parts; an item that is whole has none.
HEAD, TAIL, NO_GROUP, END = "head", "tail", "no group", "end"

# The code of what begins a block: an item of which only the fields are in it.
_BEFORE = -1

_KINDS = {"part": pa.string(), "file": pa.string(), "block": pa.int64(), "opened": pa.string(), "texts": pa.list_(pa.string()), "group": pa.string()}
_SCHEMA = pa.schema([pa.field(n, t) for n, t in _KINDS.items()])
SCHEMA = "part string, file string, block long, opened string, texts array<string>, `group` string"


def all_fields(groups: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The fields of all groups, in the order in which parts have their texts."""
    return tuple(sorted({f for fields in groups.values() for f in fields}))


def assembled(groups: dict[str, tuple[str, ...]], item: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow`` from (file, block, tag, value) to ``SCHEMA``: texts are by a group's fields.

    An item begins with the tag of its group, or with the tag ``item`` after the one of its group. Texts of parts, and of
    items without a group, are by the fields of all groups; a field that is there without a text has an empty one in a part.
    """
    fields, names = all_fields(groups), pa.array([*groups])
    begin, opening = ([item], [*groups]) if item else ([*groups], [])
    known, first_field = pa.array([*begin, *opening, *fields]), len(begin) + len(opening)
    # Where a group has a field, -1 if it does not; at last for items without a group.
    widths = np.array([*map(len, groups.values()), len(fields)])
    places = np.array([[own.index(f) if f in own else -1 for f in fields] for own in (*groups.values(), fields)])

    class Block:
        """The block that is being read: ``codes`` and ``values`` of its open item (no field twice), and groups by number."""

        def __init__(self, file: str, block: int):
            self.file, self.block = file, block
            self.codes, self.values = np.array([_BEFORE]), pa.array([None], pa.string())
            self.group = self.opened = -1

        def part(self, kind: str, group: int, with_fields: bool = True) -> dict:
            told = dict(zip(self.codes.tolist(), self.values.to_pylist(), strict=True)) if with_fields else {}
            texts = [told[c] or "" if c in told else None for c in range(first_field, first_field + len(fields))]
            return {"part": kind, "file": self.file, "block": self.block, "opened": names[int(group)].as_py() if group >= 0 else None, "texts": texts}

        def open_item(self) -> list[dict]:
            if self.codes[0] == _BEFORE:
                return [self.part(HEAD, -1)] if len(self.codes) > 1 else []
            return [self.part(TAIL, self.group)]

        def end(self) -> list[dict]:
            return self.open_item() + ([self.part(END, self.opened, False)] if opening else [])

        def read(self, codes: np.ndarray, values: pa.Array) -> tuple[list[dict], pa.RecordBatch | None]:
            """Reads on; returns a part that ended, and the items that are whole."""
            codes, values = np.concatenate([self.codes, codes]), pa.concat_arrays([self.values, values])
            starts = np.flatnonzero(codes < len(begin))
            if opening:
                last = np.maximum.accumulate(np.where((codes >= len(begin)) & (codes < first_field), np.arange(len(codes)), -1))
                opened = np.where(last >= 0, codes[last] - len(begin), self.opened)
                group, self.opened = opened[starts], opened[-1]
            else:
                group = codes[starts]
            group[0] = self.group
            parts, whole = [], None
            if len(starts) > 1:
                begun = int(codes[0] == _BEFORE)
                if begun:
                    self._hold(codes[: starts[1]], values[: starts[1]])
                    parts = self.open_item()
                if len(starts) > 1 + begun:
                    whole = self._whole(codes, values, starts[begun:], group[begun:-1])
            self.group = group[-1]
            self._hold(codes[starts[-1] :], values[starts[-1] :])
            return parts, whole

        def _hold(self, codes: np.ndarray, values: pa.Array) -> None:
            """The beginning of an item, and the last of each of its fields."""
            kept, back = np.unique(codes[::-1], return_index=True)
            needed = (kept < len(begin)) | (kept >= first_field)
            self.codes, self.values = kept[needed], values.take(pa.array(len(codes) - 1 - back[needed]))

        def _whole(self, codes: np.ndarray, values: pa.Array, starts: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
            """One row for each item but the last, which is open."""
            rows = np.arange(starts[0], starts[-1])
            rows = rows[codes[rows] >= first_field]
            number = np.searchsorted(starts, rows, "right") - 1
            offsets = np.concatenate([[0], np.cumsum(widths[group])])
            place = places[group[number], codes[rows] - first_field]
            told = place >= 0
            at = np.full(offsets[-1], -1)
            at[offsets[number[told]] + place[told]] = rows[told]  # of a field that is there twice the last
            texts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(at, mask=at < 0)))
            lost = group < 0
            where = (NO_GROUP, self.file, self.block, None)
            given = [pa.nulls(len(group), kind) for kind in list(_KINDS.values())[:4]]
            if lost.any():
                given = [pc.if_else(pa.array(lost), pa.scalar(x, g.type), g) for x, g in zip(where, given, strict=True)]
            return pa.RecordBatch.from_arrays([*given, texts, names.take(pa.array(group, mask=lost))], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            parts = []
            for file, block, rows in _by_block(batch):
                if now is None or (now.file, now.block) != (file, block):
                    parts += now.end() if now else []
                    now = Block(file, block)
                codes = pc.fill_null(pc.index_in(rows.column(2), value_set=known), -1).to_numpy().astype(np.int64)
                values = rows.column(3)
                if codes.min() < 0:
                    values, codes = values.filter(pa.array(codes >= 0)), codes[codes >= 0]
                more, whole = now.read(codes, values)
                parts += more
                if whole is not None:
                    yield whole
            if parts:
                yield pa.RecordBatch.from_pylist(parts, schema=_SCHEMA)
        if now and (parts := now.end()):
            yield pa.RecordBatch.from_pylist(parts, schema=_SCHEMA)

    return run


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch by file and block; the rows of a block follow each other."""
    if batch.num_rows == 0:
        return
    file, block = batch.column(0), batch.column(1)
    cuts = []
    if file[0] != file[-1] or block[0] != block[-1]:
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = (np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield file[start].as_py(), block[start].as_py(), batch.slice(start, end - start)
