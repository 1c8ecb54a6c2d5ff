"""Span dumps as a data source: spark.read.format("span_dumps").load(folder), with filters on path and page pushed into the reader.

Another kind of dump is a subclass of SpanReader with its own pages(); another store one with its own files() and opened().
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

COLUMNS = "path string, page int, ix int, left double, right double, top double, bottom double, text string, font_name string, font_size double, bold boolean, italic boolean, skew double"
#: Bytes of files that share a partition, about; rows of a batch.
PART_BYTES, BATCH_ROWS = 32 << 20, 20_000


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class SpanReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.part_bytes = options["path"], int(options.get("partBytes", PART_BYTES))
        self.tests: list = []

    def pushFilters(self, filters):
        """Takes comparisons of page, and of path with a value or a beginning; what else there is stays with Spark."""
        for f in filters:
            of = f.attribute if hasattr(f, "attribute") else ()
            if of == ("page",) and isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) or of == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((of[0], type(f).__name__, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def passes(self, column: str, value) -> bool:
        """Whether a value of the column passes all tests of it; null passes none."""
        is_ = {"EqualTo": lambda x: value == x, "In": lambda x: value in x, "LessThan": lambda x: value < x, "LessThanOrEqual": lambda x: value <= x, "GreaterThan": lambda x: value > x, "GreaterThanOrEqual": lambda x: value >= x, "StringStartsWith": lambda x: value.startswith(x)}
        return all(value is not None and is_[kind](x) for c, kind, x in self.tests if c == column)

    def files(self) -> list[tuple[str, int]]:
        """Paths and sizes of the JSON files below the folder, in order. Any store that Arrow's file systems reach."""
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.path.rsplit(".", 1)[-1] in ("json", "jsonl") and not f.base_name.startswith((".", "_")))

    def opened(self, path: str):
        """The file as a binary stream; another reader may give its bytes."""
        import io

        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.root)
        return io.BufferedReader(store.open_input_file(path), 1 << 20)

    def pages(self, raw):
        """Page objects of a dump (a stream or bytes): lines of pages, a list, or one object with them in `data`. What is no JSON is left out.

        Lines are read one at a time, and no more than one page is held. Only a file whose first line is the beginning of a list or an
        object, and no value for itself, is read whole, as one value.
        """
        import io
        import json

        def told(text):
            try:
                return json.loads(text)
            except ValueError:
                return None

        def within(whole):
            return whole.get("data", [whole]) if isinstance(whole, dict) else whole if isinstance(whole, list) else []

        def lines_of(stream):
            stream.seek(0)
            return (line for block in stream for line in block.splitlines() if line.strip(b" \t\r\n"))

        def values(stream):
            first = next(lines := lines_of(stream), b"")
            value = told(first)
            if value is None and first.lstrip(b" \t")[:1] in (b"[", b"{", b"\0", b"\xef", b"\xfe", b"\xff"):
                stream.seek(0)
                whole = told(stream.read())
                if isinstance(whole, (dict, list)):
                    yield from within(whole)
                    return
                next(lines := lines_of(stream))
            second = next(lines, None)
            if second is None:  # the file is this value
                yield from within(value)
                return
            yield value
            yield told(second)
            yield from map(told, lines)

        with io.BytesIO(raw) if isinstance(raw, bytes) else raw as stream:
            for p in values(stream):
                if isinstance(p, dict) and isinstance(p.get("spans"), list):
                    yield p

    def partitions(self):
        parts, held, size = [], [], 0
        for path, n in self.files():
            if self.passes("path", path):
                if held and size + n > self.part_bytes:
                    parts.append(Files(held))
                    held, size = [], 0
                held.append(path)
                size += n
        return parts + [Files(held)]

    def read(self, partition):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        schema, rows = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in COLUMNS.split(", ")]), []
        number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None

        def told():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for path in partition.paths:
            for page in self.pages(self.opened(path)):
                if not self.passes("page", page.get("page")):
                    continue
                for ix, s in enumerate(x for x in page["spans"] if isinstance(x, dict)):
                    box = [*(number(v) for v in (s.get("bbox") or [])), None, None, None, None][:4]
                    rows.append((path, page.get("page"), ix, *box, s.get("text"), s.get("font_name"), number(s.get("font_size")), bool(s.get("bold")), bool(s.get("italic")), number(s.get("skew"))))
                    if len(rows) >= BATCH_ROWS:
                        yield told()
        if rows:
            yield told()


class SpanDumps(DataSource):
    """A row for each span: path, page, ix, left, right, top, bottom, text, font_name, font_size, bold, italic, skew. Options: path (a folder), partBytes."""

    reads = SpanReader

    @classmethod
    def name(cls) -> str:
        return "span_dumps"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema):
        return self.reads(self.options)


def register(spark: SparkSession, source: type[DataSource] = SpanDumps) -> None:
    """Makes the source known to the session, and lets Spark push filters into it. Its classes travel by value, so executors need no copy of this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
