"""Evidence: text chunks, exact nearest neighbours by a metric join, and a store of vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import chunk_rows
from ledgerlens.operators.ranges import numbered
from ledgerlens.sources.tables import written

#: Bytes of query vectors that are sent out at once; more queries go in further blocks.
BLOCK_BYTES = 32 << 20
#: Rows that are taken as pivots: the square root of the rows, at most so many.
MOST_PIVOTS = 256
#: Neighbouring rows of a cell that are skipped or held against queries together, queries at once, finds that a task holds before it thins them.
CHUNK_ROWS, AT_ONCE, HELD = 1024, 512, 1 << 20


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, position, id, text, page) of each chunk of each text."""
    return docs.select(id_col, F.posexplode(chunk_rows(F.col(text_col))).alias("position", "c")).select(id_col, "position", "c.id", "c.text", "c.page")


def page_chunks(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same of pages (id_col, page, text)."""
    return pages.select(id_col, F.explode(chunk_rows(F.col("text"), F.col("page"))).alias("c")).select(id_col, "c.id", "c.text", "c.page")


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def _usable(rows: DataFrame, key: str, vector: str, key_name: str) -> DataFrame:
    """Rows with an id and a vector of finite numbers, as doubles; no others have a distance."""
    v = F.col("_v")
    own = rows.select(F.col(key).alias(key_name), F.col(vector).cast("array<double>").alias("_v"))
    return own.where(F.col(key_name).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < math.inf, F.lit(False)) & ~F.isnan(x)))


class Cells:
    """Pivots by length of vector: a cell is what is nearest to one of them. Lengths that the sample lacks have the zero vector for a pivot."""

    def __init__(self, vectors: list[list[float]]):
        self.most, self.pivots = len(vectors) + 1, {}
        for v in vectors:
            self.pivots.setdefault(len(v), []).append(v)

    def of(self, dim: int):
        import numpy as np

        return np.array(self.pivots.get(dim) or [[0.0] * dim])

    def distances(self, vectors):
        """Of each vector (one length) to each pivot of its length. Good to about 1e-7 of the norms; SLACK covers it."""
        import numpy as np

        p = self.of(vectors.shape[1])
        return np.sqrt(np.maximum((vectors**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * vectors @ p.T, 0))


#: What rounding can do to a distance by squares, as a part of the norms.
SLACK = 1e-6


def celled(rows: DataFrame, cells: Cells, key: str) -> DataFrame:
    """Adds _cell (length of vector times the pivots, and the nearest pivot) and _d, the distance to it."""
    kind = rows.schema[key].dataType.simpleString()

    def assign(parts):
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            for dim, take, own in _by_length(batch.column(1)):
                d = cells.distances(own)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(dim * cells.most + near, pa.int64()), pa.array(d[np.arange(len(near)), near])], names=[key, "_v", "_cell", "_d"]
                )

    return rows.select(key, "_v").mapInArrow(assign, f"{key} {kind}, _v array<double>, _cell long, _d double")


def _by_length(vectors):
    """(length, places, matrix) of the vectors of each length in an Arrow list column."""
    import numpy as np
    import pyarrow as pa

    offsets = np.asarray(vectors.offsets)
    sizes, flat = np.diff(offsets), vectors.values.to_numpy()
    for dim in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == dim)
        yield dim, pa.array(places), flat[(offsets[places][:, None] + np.arange(dim)[None, :])]


class Scan:
    """Holds a block of queries against rows that come cell by cell, nearest to the pivot first.

    ``bound`` is each query's upper bound of the k-th distance so far. A chunk of a cell whose distances to the pivot all differ from
    the query's own by more than the bound is skipped, as is a cell on the far side of the plane halfway to the query's own pivot.
    """

    def __init__(self, cells: Cells, ids: list, vectors, bound, k: int, same: bool, own_cells: bool):
        import numpy as np

        self.cells, self.ids, self.q, self.bound, self.k, self.own_cells = cells, ids, vectors, bound.copy(), k, own_cells
        self.to_pivots, self.norms = cells.distances(vectors), (vectors**2).sum(1)
        p = cells.of(vectors.shape[1])
        self.between = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(2))
        self.home = self.to_pivots.argmin(1)
        self.places: dict = {}
        for i, x in enumerate([] if same else ids):
            self.places.setdefault(x, []).append(i)
        self.found, self.held, self.touched = [], 0, 0

    def beyond(self, pivot: int):
        """Least distance of each query to anything in a pivot's cell, by the plane halfway to its own pivot."""
        import numpy as np

        own, far = self.to_pivots[np.arange(len(self.home)), self.home], self.between[self.home, pivot]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(far > 0, (self.to_pivots[:, pivot] ** 2 - own**2) / (2 * far), 0.0)

    def add(self, cell: int, keys: list, rows, d) -> None:
        """rows of one cell, with their distances d to its pivot in growing order."""
        import numpy as np

        dim, pivot = divmod(cell, self.cells.most)
        if dim != self.q.shape[1]:
            return
        for at in range(0, len(keys), CHUNK_ROWS):
            part = slice(at, at + CHUNK_ROWS)
            to = self.to_pivots[:, pivot]
            gap = np.maximum(np.maximum(d[part][0] - to, to - d[part][-1]), self.beyond(pivot))
            slack = SLACK * (np.sqrt(self.norms) + np.abs(d[part][-1]) + to)
            wanted = np.flatnonzero((gap <= self.bound + slack) & ((self.home == pivot) == self.own_cells))  # each cell in one of the two scans
            for i in range(0, len(wanted), AT_ONCE):
                self._compare(wanted[i : i + AT_ONCE], keys[part], rows[part])

    def _compare(self, some, keys: list, rows) -> None:
        import numpy as np

        self.touched += len(some) * len(keys)
        norms = (rows**2).sum(1)
        near = self.norms[some][:, None] + norms[None, :] - 2 * self.q[some] @ rows.T
        if self.places:
            place = {int(x): i for i, x in enumerate(some)}
            for j, x in enumerate(keys):
                for i in self.places.get(x, ()):
                    if i in place:
                        near[place[i], j] = np.inf
        slack = SLACK**2 * (self.norms[some] + norms.max())
        limit = self.bound[some] ** 2 + slack
        if len(keys) >= self.k:
            limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + slack)
        i, j = np.nonzero((near <= limit[:, None]) & (near < np.inf))
        if not len(i):
            return
        total = np.zeros(len(i))
        a, b = self.q[some][i], rows[j]
        for c in range(a.shape[1]):  # in the order of the components, so that the last bit is that of a sum from left to right
            total += (a[:, c] - b[:, c]) ** 2
        self.found.append((some[i], np.array(keys, dtype=object)[j], np.sqrt(total)))
        self.held += len(i)
        if self.held > HELD:
            self.thin()

    def thin(self):
        """The k nearest so far of each query, ties to the smaller id; the k-th tightens its bound."""
        import numpy as np
        import pandas as pd

        if not self.found:
            return pd.DataFrame({"q": [], "r": [], "d": []})
        q, r, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        own = pd.DataFrame({"q": q, "r": r, "d": d}).sort_values(["q", "d", "r"], kind="stable").groupby("q").head(self.k)
        kth = own.groupby("q").nth(self.k - 1)
        self.bound[kth["q"].to_numpy()] = np.minimum(self.bound[kth["q"].to_numpy()], kth["d"].to_numpy())
        self.found, self.held = [(own["q"].to_numpy(), own["r"].to_numpy(), own["d"].to_numpy())], len(own)
        return own


def _scanned(table: DataFrame, cells: Cells, ids: list, vectors, bound, k: int, same: bool, own_cells: bool, touched=None) -> DataFrame:
    """(_qi, _r, distance): what each task finds of its rows for the block's queries, k at most of each."""
    kind = table.schema["_r"].dataType
    sent = table.sparkSession.sparkContext.broadcast((cells, ids, vectors, bound))

    def search(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        scan = Scan(*sent.value, k, same, own_cells)
        for batch in parts:
            if not len(batch):
                continue
            import numpy as np

            cell, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:], strict=False):
                ((_, _, rows),) = _by_length(batch.column(1)[a:b])
                order = np.argsort(d[a:b], kind="stable")  # files of one cell may follow each other in a task
                keys = batch.column(0)[a:b].to_pylist()
                scan.add(int(cell[a]), [keys[i] for i in order], rows[order], d[a:b][order])
        own = scan.thin()
        if touched is not None:
            touched.add(scan.touched)
        yield pa.RecordBatch.from_arrays([pa.array(own["q"].to_numpy(), pa.int32()), pa.array(own["r"].tolist(), to_arrow_type(kind)), pa.array(own["d"].to_numpy(), pa.float64())], names=["_qi", "_r", "distance"])

    return table.select("_r", "_v", "_cell", "_d").mapInArrow(search, f"_qi int, _r {kind.simpleString()}, distance double")


def nearest(queries: DataFrame, rows: DataFrame, k: int = 3, *, query_id: str = "query_id", query_vector: str = "vector", row_id: str = "id", row_vector: str = "vector", same: bool = False, touched=None) -> DataFrame:
    """(query_id, rank, row_id, distance): the k nearest rows of each query by Euclidean distance, ties to the smaller id.

    An exact metric join. Rows are dealt to the cell of their nearest pivot and stored in the order of cell and distance to the pivot. Blocks of
    queries of BLOCK_BYTES at most are sent to the rows, first to those of their own cells alone; the k-th distance
    found there bounds the second scan, which reads the cells that the triangle inequality leaves open for a query of the block, skips
    chunks of them in the same way and tightens the bound as it goes. A query is not its own neighbour, unless ``same``.

    Vectors that are null, empty, of another length than the query's or hold null or non-finite numbers take no part, and neither
    do rows without an id. Repeated rows count each. A query with no rows to compare has no result. touched: an accumulator that counts the pairs compared.
    """
    import numpy as np

    k = max(1, k)
    spark = rows.sparkSession
    own = _usable(rows, row_id, row_vector, "_r")
    n = own.count()
    sample = own.orderBy(F.xxhash64("_r"), "_r").limit(max(1, min(MOST_PIVOTS, math.isqrt(n)))).select("_v").collect()
    cells = Cells([r[0] for r in sample])
    place = [F.col("_cell"), F.col("_d")]
    table = written(celled(own, cells, "_r").repartitionByRange(*place).sortWithinPartitions(*place), "cells")
    extent = {r["_cell"]: (r["lo"], r["hi"]) for r in table.groupBy("_cell").agg(F.min("_d").alias("lo"), F.max("_d").alias("hi")).collect()}  # a row for each pivot
    asked = written(celled(_usable(queries, query_id, query_vector, "_q"), cells, "_q"), "queries")
    out = None
    paths = []
    for dim, count in asked.groupBy(F.size("_v")).count().collect():  # a row for each length of vector
        size = max(1, BLOCK_BYTES // (8 * dim))
        blocks = -(-count // size)
        of_length = asked.where(F.size("_v") == dim)
        # Blocks of neighbouring queries need few cells.
        parted = written(numbered(of_length, [*place, F.col("_q")], "_n").withColumn("_block", F.floor((F.col("_n") - 1) / size)), "blocks") if blocks > 1 else of_length.withColumn("_block", F.lit(0))
        for b in range(blocks):
            held = parted.where(F.col("_block") == b).select("_q", "_v").orderBy("_q").collect()
            ids, vectors = [r[0] for r in held], np.array([r[1] for r in held])
            scan = _scanned(table.where(F.col("_cell").isin(sorted({dim * cells.most + int(c) for c in cells.distances(vectors).argmin(1)}))), cells, ids, vectors, np.full(len(ids), np.inf), k, same, True, touched)
            w = Window.partitionBy("_qi").orderBy("distance", "_r")
            first = written(scan.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k), "near")
            bound = np.full(len(ids), np.inf)
            for r in first.where(F.col("_k") == k).select("_qi", "distance").collect():
                bound[r[0]] = r[1]
            d = cells.distances(vectors)
            home = d.argmin(1)
            slack = SLACK * (np.sqrt((vectors**2).sum(1)) + d.max(1))
            whole = Scan(cells, ids, vectors, bound, k, same, False)
            left = []
            for cell, (lo, hi) in extent.items():
                length, pivot = divmod(cell, cells.most)
                if length == dim:
                    gap = np.maximum(np.maximum(lo - d[:, pivot], d[:, pivot] - hi), whole.beyond(pivot))
                    if ((gap <= bound + slack + SLACK * hi) & (home != pivot)).any():
                        left.append(cell)
            rest = _scanned(table.where(F.col("_cell").isin(left)), cells, ids, vectors, bound, k, same, False, touched)
            ranked = first.drop("_k").unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            kind = asked.schema["_q"].dataType.simpleString()
            names = spark.createDataFrame(list(enumerate(ids)), f"_i int, _q {kind}")
            done = ranked.join(F.broadcast(names), F.col("_qi") == F.col("_i")).select(F.col("_q").alias(query_id), "rank", F.col("_r").alias(row_id), "distance")
            if blocks == 1:
                out = done if out is None else out.unionByName(done)
            else:
                paths.append(written(done, "nearest"))
    for done in paths:
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], f"{query_id} {asked.schema['_q'].dataType.simpleString()}, rank int, {row_id} {table.schema['_r'].dataType.simpleString()}, distance double")
    return out


def append_missing(store: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose document the store lacks: what an upsert that indexes each document once appends."""
    return fresh.join(store.select(key).distinct(), key, "left_anti")


def label_vote(neighbours: DataFrame, labels: DataFrame, *, query_id: str = "query_id", row_id: str = "id", label: str = "label") -> DataFrame:
    """The most frequent label among each query's neighbours, the smallest in a tie, and its votes."""
    votes = neighbours.join(labels, row_id).groupBy(query_id, label).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(query_id).orderBy(F.desc("votes"), label)
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
