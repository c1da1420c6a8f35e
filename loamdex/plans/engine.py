"""The engine: an index in a folder, and the questions that can be asked of it.

The index is a row of snapshots, each a folder of parquet tables; a new one is
written beside the old and the pointer moves last, so readers never see half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.functions.vectors import embed_text, embedder
from loamdex.operators import graph as G, search as S, tables as T, wiki as K
from loamdex.session import Stages
from loamdex.sources import parse as P
from loamdex.sources.coderepo import CodeRepo, read_files

TABLES = ("symbols", "edges", "chunks", "chunk_vectors", "file_manifest")
DIM = 64


class Engine:
    """``stemmed`` folds accents and stems words of the lexical index; ``dim`` is that of new vectors. What an index was made with is in its metadata."""

    def __init__(self, spark: SparkSession, folder: str, stemmed: bool = True, dim: int = DIM):
        self.spark, self.folder, self.stemmed, self.dim = spark, folder.rstrip("/"), stemmed, dim
        spark.dataSource.register(CodeRepo)

    # ------------------------------------------------------------ snapshots

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def snapshot(self) -> int:
        """Number of the present snapshot, 0 before the first: the largest name in the pointer folder."""
        fs, p = self._fs(f"{self.folder}/pointer")
        return max((int(f.getPath().getName()) for f in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.snapshot()}/{name}")

    def metadata(self) -> dict[str, str]:
        """Key and value of what the index was made with; empty before the first snapshot."""
        fs, p = self._fs(f"{self.folder}/{self.snapshot()}/metadata")
        return {r["key"]: r["value"] for r in self.spark.read.parquet(str(p)).collect()} if fs.exists(p) else {}  # a few rows

    def _publish(self, tables: dict[str, DataFrame]) -> None:
        n = self.snapshot() + 1
        made = lambda name: f"{self.folder}/{n}/{name}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(made(name))
        read = lambda name: self.spark.read.parquet(made(name))
        G.link(read("symbols"), read("edges")).write.mode("overwrite").parquet(made("links"))
        for name, df in zip(("postings", "lengths"), S.build_postings(read("chunks"), "chunk_id", S.chunk_words(self.stemmed), S.chunk_version())):
            df.write.mode("overwrite").parquet(made(name))
        facts = {"embedding_model": "hashed-trigrams", "embedding_dim": str(self.dim), "stemmed": str(self.stemmed).lower()}
        self.spark.createDataFrame(list(facts.items()), "key string, value string").write.mode("overwrite").parquet(made("metadata"))
        fs, p = self._fs(f"{self.folder}/pointer/{n}")
        fs.create(p).close()

    # ------------------------------------------------------------ indexing

    def changes(self, repo: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
        """``file_path, change`` of every file since the present snapshot, and the files whose size or time differ, with
        content and hash. Only these are opened."""
        st = Stages(self.spark, "index")
        listed = st.save(self.spark.read.format("coderepo").option("path", repo).option("content", "false").load().drop("content"))
        if not self.snapshot() or force:
            stored = listed.limit(0).select("file_path", F.lit("").alias("content_hash"), "mtime", "size")
        else:
            stored = self.table("file_manifest")
        stat = stored.select("file_path", F.col("size").alias("n0"), F.col("mtime").alias("t0"), F.col("content_hash").alias("h0"))
        old = listed.join(stat, "file_path", "left")
        same = F.coalesce((F.col("size") == F.col("n0")) & (F.abs(F.col("mtime") - F.col("t0")) < 1e-4), F.lit(False))
        opened = st.save(read_files(old.where(~same).select(*listed.columns)).withColumn("content_hash", F.sha2("content", 256)))
        now = old.where(same).select("file_path", F.col("h0").alias("content_hash"), "mtime", "size").unionByName(opened.select("file_path", "content_hash", "mtime", "size"))
        return st.save(T.manifest_changes(stored, now)), opened

    def index(self, repo: str, force: bool = False) -> int:
        """Bring the index up to date with a repository; the number of files that were parsed.

        A file that was only touched gets its new time in the manifest. Links are made again when
        something changed and kept with the snapshot.
        """
        change, opened = self.changes(repo, force)
        files = opened.join(change.where("change in ('added', 'changed')"), "file_path", "left_semi")
        n = files.count()
        gone = change.where("change in ('changed', 'deleted', 'touched')").select("file_path", "change")
        if n or not self.snapshot() or not gone.isEmpty():
            parsed = Stages(self.spark, "parsed").save(P.parse(files))  # once, for all that is made of it
            new = P.split(parsed)
            new["chunk_vectors"] = new["chunks"].select("chunk_id", embedder(self.dim)("content").alias("embedding"), F.lit(self.dim).alias("dim"))
            touched = opened.join(change.where("change <> 'same'"), "file_path", "left_semi")
            new["file_manifest"] = touched.select("file_path", "content_hash", "mtime", "size", "language", F.current_timestamp().alias("indexed_at"))
            if self.snapshot() and not force:
                kept = self._without({t: self.table(t) for t in TABLES}, gone.where("change <> 'touched'").select("file_path"))
                kept["file_manifest"] = self.table("file_manifest").join(gone, "file_path", "left_anti")
                new = {t: kept[t].unionByName(new[t]) for t in TABLES}
            new["symbols"] = T.upsert(new["symbols"], ["node_id"], [F.col("start_line")])
            new["edges"] = T.insert_ignore(new["edges"], ["source_id", "target_id", "edge_type"], [F.col("metadata")["line"].cast("int")])
            new["chunks"] = T.upsert(new["chunks"], ["chunk_id"], [F.col("start_line"), F.col("content_hash")])
            new["chunk_vectors"] = T.upsert(new["chunk_vectors"], ["chunk_id"], [F.col("embedding").cast("string")])
            self._publish(new)
        return n

    @staticmethod
    def _without(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
        """Raw edges are kept by the file they come from, so callers elsewhere keep their links."""
        out = T.remove_files(tables, files)
        gone = tables["symbols"].join(files, "file_path", "left_semi").select(F.col("node_id").alias("source_id")).distinct()
        return out | {"edges": tables["edges"].join(gone, "source_id", "left_anti")}

    def watch(self, repo: str, once: bool = False, seconds: int = 5):
        """Index again and again as a streaming query."""
        from loamdex.streaming.watch import watch

        return watch(self, repo, once, seconds)

    # ------------------------------------------------------------ questions

    def edges(self) -> DataFrame:
        """Edges with the by-name targets that were resolved when the snapshot was made."""
        return G.linked_edges(self.table("edges"), self.table("links"))

    def search(self, query: str, limit: int = 5, mode: str = "hybrid", expand: bool = False, depth: int = 1) -> DataFrame:
        """The best chunks; with ``expand`` a row for each symbol within ``depth`` hops of a chunk's, in ``neighbour``.

        The query is embedded and stemmed as the metadata of the index say.
        """
        made = self.metadata()
        vector = [float(x) for x in embed_text(query, int(made.get("embedding_dim", self.dim)))]
        stemmed = made.get("stemmed", str(self.stemmed).lower()) == "true"
        found = S.search(self.table("chunks"), self.table("chunk_vectors"), query, vector, limit, mode, stemmed, (self.table("postings"), self.table("lengths")))
        if not expand:
            return found
        more = S.neighbour_rows(found, self.edges(), self.table("symbols"), depth)
        return found.join(more, "chunk_id", "left").orderBy(F.desc("score"), "chunk_id", "level", "neighbour.node_id")

    def answer(self, query: str, limit: int = 5, mode: str = "hybrid") -> DataFrame:
        """What a caller is shown: scores to four digits and three neighbours of each result."""
        found = S.search(self.table("chunks"), self.table("chunk_vectors"), query, [float(x) for x in embed_text(query, int(self.metadata()["embedding_dim"]))], limit, mode, self.metadata()["stemmed"] == "true", (self.table("postings"), self.table("lengths")))
        found = Stages(self.spark, "answer").save(found)
        return S.answer(found, S.neighbour_rows(found, self.edges(), self.table("symbols")))

    def _nodes(self, part: str) -> DataFrame:
        ends = self.edges().select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
        return G.resolve(ends, part, 1)

    def graph(self, symbol: str, depth: int = 1) -> DataFrame:
        return G.neighbourhood(self.edges(), self._nodes(symbol), depth)

    def impact(self, symbol: str) -> DataFrame:
        return G.impact(self.edges(), self._nodes(symbol))

    def affected(self, symbol: str) -> int:
        """How many nodes a change reaches."""
        return self.impact(symbol).count()

    def wiki(self) -> DataFrame:
        """Every page: index, architecture, workflows and modules."""
        return K.pages(self.table("symbols"), self.edges())

    def write_wiki(self, path: str) -> None:
        """Write the pages as Markdown and take them into the index as chunks of the type wiki, without vectors."""
        pages = Stages(self.spark, "wiki").save(self.wiki())
        K.write_pages(pages, path)
        tables = {t: self.table(t) for t in TABLES}
        tables["chunks"] = tables["chunks"].where("chunk_type <> 'wiki'").unionByName(K.page_chunks(pages))
        self._publish(tables)

    def stats(self) -> DataFrame:
        return T.index_stats({t: self.table(t) for t in TABLES})

    def export(self, path: str, form: str = "json") -> None:
        G.export_graph(self.table("symbols"), self.edges(), path, form)
