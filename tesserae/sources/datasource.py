"""Facts of tables as a Spark data source: spark.read.format("tesserae_facts"), whose reader is split by files and row groups.

A technology's adapter is a catalog of rules, each of which says what facts one table gives: where the ids of both ends come from, the
relation, and what evidence there is. The reader makes a partition for every rule and every stretch of a file's row groups. Filters
are pushed down: one on the relation (of nodes: on the type) leaves rules out, so that their files aren't opened; one on an end's id
leaves out rules with other prefixes, and goes to the Parquet reader as a comparison with the key column in the others.

Options: path (a folder of <table>.parquet, which may be a file or a folder of files, by any URI that Arrow's file systems open), facts
(nodes or edges), rules (module:name of a catalog; by default the driver's tables), subject, scan, and split_bytes.
"""

from __future__ import annotations

import importlib
import operator
import posixpath
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from tesserae.schema import EVIDENCE, not_blank, require

NAME = "tesserae_facts"
_HEAD = "subject_id string, scan_id string"
NODE_FACTS = f"{_HEAD}, id string, type string, attributes map<string,string>, evidence array<{EVIDENCE}>"
EDGE_FACTS = f"{_HEAD}, src_id string, dst_id string, dst_desc string, relation string, provenance array<{EVIDENCE}>"
SPLIT, ROWS, LOOKED_UP = 64 << 20, 65_536, 1 << 20
_OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Key:
    """An id: a prefix and the text of an integer column; halved takes the integer's half, rounded down."""

    prefix: str
    column: str
    halved: bool = False

    def ids(self, t: pa.Table) -> pa.Array:
        values = pc.floor(pc.divide(pc.cast(t[self.column], pa.float64()), 2)) if self.halved else t[self.column]
        return pc.binary_join_element_wise(self.prefix, pc.cast(pc.cast(values, pa.int64()), pa.string()), "")

    def matching(self, id_: str) -> ds.Expression | None:
        """What the column must be for this id; None where no row of the rule has it."""
        rest = id_[len(self.prefix) :] if id_.startswith(self.prefix) else ""
        if not rest.removeprefix("-").isdigit() or str(int(rest)) != rest:
            return None
        if self.halved:
            return (ds.field(self.column) >= 2 * int(rest)) & (ds.field(self.column) <= 2 * int(rest) + 1)
        return ds.field(self.column) == int(rest)


Where = tuple[str, str, object]


@dataclass(frozen=True)
class NodeRule:
    """A node of a type for each row; evidence gives (adapter, description, annotation) arrays, null where there is none."""

    table: str
    label: str
    key: Key
    evidence: Callable[[pa.Table], tuple[pa.Array, pa.Array, pa.Array]] | None = None
    reads: tuple[str, ...] = ()

    def ends(self) -> dict[str, Key | None]:
        return {"id": self.key}

    def columns(self) -> set[str]:
        return {self.key.column, *self.reads}


@dataclass(frozen=True)
class Lookup:
    """A column of another table, found by a key that this table has; the other table is streamed for LOOKED_UP rows at once, in their range of keys alone."""

    table: str
    key: str
    column: str
    by: str


@dataclass(frozen=True)
class EdgeRule:
    """An edge of a relation for each row that where holds for; without dst its end is unresolved and described."""

    table: str
    label: str
    src: Key
    dst: Key | None
    dst_desc: str | None = None
    where: Where | None = None
    iterated: Where | None = None
    lookup: Lookup | None = None

    def ends(self) -> dict[str, Key | None]:
        return {"src_id": self.src, "dst_id": self.dst}

    def columns(self) -> set[str]:
        own = {k.column for k in (self.src, self.dst) if k} | {w[0] for w in (self.where, self.iterated) if w}
        return (own - {self.lookup.column}) | {self.lookup.by} if self.lookup else own


@dataclass
class Part(InputPartition):
    """Row groups of one file for one rule."""

    rule: int
    file: str
    groups: tuple[int, ...]
    ids: dict[str, tuple[str, ...]] = field(default_factory=dict)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _scanned(fragment: ds.ParquetFileFragment, columns: list[str], where: ds.Expression | None) -> Iterator[pa.Table]:
    """The fragment's rows, batch by batch; nothing is read ahead, and a row group isn't held whole."""
    streamed = ds.ParquetFragmentScanOptions(use_buffered_stream=True, buffer_size=1 << 20, pre_buffer=False)
    for group in fragment.split_by_row_group(where):
        for batch in group.to_batches(columns=columns, filter=where, batch_size=ROWS, use_threads=False, batch_readahead=0, fragment_readahead=0, fragment_scan_options=streamed):
            if batch.num_rows:
                yield pa.Table.from_batches([batch])


def _gathered(tables: Iterator[pa.Table], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of about so many."""
    held: list[pa.Table] = []
    for t in tables:
        held.append(t)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_tables(held)
            held = []
    if held:
        yield pa.concat_tables(held)


def _records(adapter: pa.Array, description: pa.Array, context: pa.Array, fidelity: str, annotation: pa.Array) -> pa.Array:
    """A list of one evidence record for each row, or an empty list where the adapter is null."""
    n = len(adapter)
    text = lambda x: pa.array([x] * n, pa.string()) if x is None or isinstance(x, str) else x
    there = annotation.is_valid()
    at = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.cast(there, pa.int32()))])
    attributes = pa.MapArray.from_arrays(at, pa.array(["annotation"] * int(pc.sum(pc.cast(there, pa.int32())).as_py() or 0), pa.string()), annotation.drop_null())
    structs = pa.StructArray.from_arrays([text(adapter), text(description), text(None), text(fidelity), text(context), attributes], ["source_adapter", "description", "location", "fidelity", "execution_context", "attributes"])
    has = text(adapter).is_valid()
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.cast(has, pa.int32()))])
    return pa.ListArray.from_arrays(offsets, structs.filter(has))


def catalog(rules: str) -> tuple[Sequence[NodeRule], Sequence[EdgeRule]]:
    """(rules of nodes, rules of edges) by module:name."""
    module, _, name = rules.partition(":")
    return getattr(importlib.import_module(module), name)


class FactReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = not_blank(options.get("path"), "path").rstrip("/")
        self.facts = options.get("facts", "edges")
        require(self.facts in ("nodes", "edges"), "facts are nodes or edges")
        self.subject, self.scan = options.get("subject", "shop"), options.get("scan", "scan-1")
        self.split = int(options.get("split_bytes", SPLIT))
        self.catalog = options.get("rules", "tesserae.sources.shop:RULES")
        self.labels: set[str] | None = None
        self.ids: dict[str, tuple[str, ...]] = {}

    def rules(self) -> Sequence[NodeRule | EdgeRule]:
        return catalog(self.catalog)[self.facts == "edges"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of the label in full; those of ids prune, and Spark holds them, too, as it holds all others."""
        label = "relation" if self.facts == "edges" else "type"
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name == label:
                self.labels = set(values) if self.labels is None else self.labels & set(values)
                continue
            if name in ("id", "src_id", "dst_id"):
                mine = tuple(v for v in values if v is not None)
                self.ids[name] = tuple(v for v in self.ids[name] if v in mine) if name in self.ids else mine
            yield f

    def partitions(self) -> Sequence[Part]:
        import pyarrow.parquet as pq

        found = []
        for i, rule in enumerate(self.rules()):
            ids = {name: tuple(v for v in self.ids[name] if key is not None and key.matching(v) is not None) for name, key in rule.ends().items() if name in self.ids}
            if self.labels is not None and rule.label not in self.labels or not all(ids.values()):
                continue
            fs, base = file_system(f"{self.path}/{rule.table}.parquet")
            about = fs.get_file_info(base)
            files = [base] if about.type == pafs.FileType.File else sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if x.type == pafs.FileType.File and not posixpath.basename(x.path).startswith(("_", ".")))
            require(bool(files), f"no table {rule.table} in {self.path}")
            for file in files:
                meta, groups, size = pq.read_metadata(file, filesystem=fs), [], 0
                for g in range(meta.num_row_groups):
                    if groups and size + meta.row_group(g).total_byte_size > self.split:
                        found.append(Part(i, file, tuple(groups), ids))
                        groups, size = [], 0
                    groups.append(g)
                    size += meta.row_group(g).total_byte_size
                if groups:
                    found.append(Part(i, file, tuple(groups), ids))
        return found

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left after pruning
            return
        rule = self.rules()[partition.rule]
        fs, _ = file_system(self.path)
        fragment = ds.ParquetFileFormat().make_fragment(partition.file, fs, row_groups=list(partition.groups))
        where = None
        for w in [rule.where] if isinstance(rule, EdgeRule) and rule.where else []:
            where = _OPS[w[1]](ds.field(w[0]), w[2])
        for name, key in rule.ends().items():
            own = rule.lookup is None or key is None or key.column != rule.lookup.column if isinstance(rule, EdgeRule) else True
            for v in [partition.ids[name]] if name in partition.ids and own else []:
                any_ = key.matching(v[0])
                for x in v[1:]:
                    any_ = any_ | key.matching(x)
                where = any_ if where is None else where & any_
        batches = _scanned(fragment, sorted(rule.columns()), where)
        if isinstance(rule, NodeRule):
            yield from (self._nodes(rule, t) for t in batches)
        elif rule.lookup is None:
            yield from (self._edges(rule, t) for t in batches)
        else:
            for t in _gathered(batches, LOOKED_UP):
                found = self._looked_up(rule.lookup, t)
                yield from (self._edges(rule, found.slice(i, ROWS)) for i in range(0, found.num_rows, ROWS))

    def _looked_up(self, lookup: Lookup, t: pa.Table) -> pa.Table:
        """t with the looked-up column; of the other table only rows that t asks for are held, however many its range of keys spans."""
        fs, base = file_system(f"{self.path}/{lookup.table}.parquet")
        wanted = pc.unique(t[lookup.by].combine_chunks()).drop_null()
        low, high = pc.min_max(wanted).values()
        span = (ds.field(lookup.key) >= low) & (ds.field(lookup.key) <= high)
        other = ds.dataset(base, filesystem=fs, format="parquet")
        names = [lookup.key, lookup.column]
        held = [pa.table([pa.array([], other.schema.field(n).type) for n in names], names)]
        for fragment in other.get_fragments(span) if len(wanted) else ():
            held += [x.filter(pc.is_in(x[lookup.key], pc.cast(wanted, x[lookup.key].type))) for x in _scanned(fragment, names, span)]
        return t.join(pa.concat_tables(held), lookup.by, lookup.key, "inner", use_threads=False)

    def _head(self, n: int) -> list[pa.Array]:
        return [pa.array([x] * n, pa.string()) for x in (self.subject, self.scan)]

    def _nodes(self, rule: NodeRule, t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        none = pa.nulls(n, pa.string())
        adapter, description, annotation = rule.evidence(t) if rule.evidence else (none, none, none)
        empty = pa.MapArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.string()), pa.array([], pa.string()))
        columns = [*self._head(n), rule.key.ids(t), pa.array([rule.label] * n, pa.string()), empty, _records(adapter, description, "UNKNOWN", "L2_SYMBOL_RESOLVED", annotation)]
        return _batch(columns, ["subject_id", "scan_id", "id", "type", "attributes", "evidence"])

    def _edges(self, rule: EdgeRule, t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        same = lambda x: pa.array([x] * n, pa.string())
        context = same("UNKNOWN")
        if rule.iterated:
            column, op, value = rule.iterated
            held = {"=": pc.equal, "<>": pc.not_equal, "<": pc.less, ">": pc.greater, ">=": pc.greater_equal}[op](t[column], value)
            context = pc.if_else(pc.fill_null(held, False), "ITERATED", "UNKNOWN")
        columns = [*self._head(n), rule.src.ids(t), rule.dst.ids(t) if rule.dst else same(None), same(rule.dst_desc), same(rule.label), _records(same("bridge"), same(rule.label), _flat(context), "L1_SYNTAX", same(None))]
        return _batch(columns, ["subject_id", "scan_id", "src_id", "dst_id", "dst_desc", "relation", "provenance"])


def _flat(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_flat(c) for c in columns], names)


class FactSource(DataSource):
    """The data source itself; register() makes it known to a session."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return NODE_FACTS if self.options.get("facts", "edges") == "nodes" else EDGE_FACTS

    def reader(self, schema: StructType) -> FactReader:
        return FactReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets Spark push filters to sources written in Python."""
    spark.dataSource.register(FactSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, facts: str = "edges", **options: str) -> DataFrame:
    register(spark)
    reader = spark.read.format(NAME).option("facts", facts)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)
