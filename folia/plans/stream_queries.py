"""Streams over the driver's tables, run until their input is used up; each stands under the SQL of its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.sources.sinks import fresh_path
from folia.sources.tables import EVENT_STATUS
from folia.streaming import stateful
from folia.streaming.guards import Limits

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Partitions of the streams' state.
PARTITIONS = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def session(spark: SparkSession) -> SparkSession:
    """A session of its own: state store and partitions are set for the stream alone."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(PARTITIONS))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    stateful.use_rocks(own)
    return own


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may name a file as well as a folder


def finished(stream: DataFrame, mode: str, reader: SparkSession | None = None) -> DataFrame:
    """What the stream has put out once its input is used up, as a table in the shared folder: a memory sink would hold all of
    it in the driver. A complete batch stands for those before it. reader: the session that reads the table."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    written: list[str] = []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{k}")
        if mode == "complete":
            written.clear()
        written.append(f"{out}/{k}")

    run = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    gone = spark._jvm.org.apache.hadoop.fs.Path(state)
    gone.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)
    reader = reader or spark
    return reader.read.schema(stream.schema).parquet(*written) if written else reader.createDataFrame([], stream.schema)


@query("""SELECT doc_id, w AS since, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT user_id AS doc_id, event_type, unnest([time_bucket(INTERVAL 1440 SECONDS, ts) - to_seconds(1440 * k) for k in range(0, 5)]) AS w, ts
  FROM events) WHERE ts < w + INTERVAL 7200 SECONDS GROUP BY ALL""")
def stream_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in windows of two hours, every 24 minutes."""
    e = source(session(spark), sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv])[F.col("event_type")]
    made = stateful.recent_error_counts(e.select(F.col("user_id").alias("doc_id"), "ts", kind.alias("status")), 7200, sliding=False)
    parts = finished(made.select("doc_id", F.col("w.start").cast("timestamp_ntz").alias("since"), "errors"), "complete", spark)
    return stateful.slid(parts, 7200)


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, text FROM conversations")
def stream_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = source(session(spark), sf_dir, "conversations")
    return finished(stateful.in_page_order(c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")), "append")


@query(r"""
WITH p AS (SELECT conv_id AS doc_id, list(trim(text, E' \n\t\r') ORDER BY turn) AS ps FROM conversations GROUP BY conv_id),
r AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE
    WHEN len(a.cur) > 0 AND list_sum(list_transform(a.cur, lambda q: length(q) // 4)) + length(x) // 4 > 60
      THEN {'out': list_append(a.out, a.cur), 'cur': list_append(list_filter(a.cur, lambda p, i: list_sum(list_transform(list_slice(a.cur, i, len(a.cur)), lambda q: length(q) // 4)) <= 20), x)}
    ELSE {'out': a.out, 'cur': list_append(a.cur, x)} END, {'out': []::VARCHAR[][], 'cur': []::VARCHAR[]}) AS a FROM p),
s AS (SELECT doc_id, list_append(r.a.out, r.a.cur) AS ss FROM r), o AS (SELECT doc_id, unnest(ss) AS s, unnest(range(0, len(ss))) AS k FROM s)
SELECT doc_id, CAST(k AS INT) AS section, array_to_string(s, E'\n\n') AS text FROM o
""")
def stream_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages that come in one batch; the last one of a conversation says so."""
    own = session(spark)
    ends = own.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.max("turn").alias("end"))
    c = source(own, sf_dir, "conversations").join(ends, "conv_id")
    pages = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text", (F.col("turn") == F.col("end")).alias("last"))
    return finished(stateful.sections(pages, 60, 20), "append")


@query()
def stream_live_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guards over documents that come as pieces; what they stop is what the replay of stored pieces stops."""
    d = source(session(spark), sf_dir, "documents").where("text != ''")
    at = F.sequence(F.lit(1), F.length("text"), F.lit(200))
    p = d.select("doc_id", "text", F.posexplode(at).alias("seq", "a"))
    pieces = p.select(
        "doc_id", F.lit(1).alias("page"), F.lit(1).alias("attempt"), "seq", F.substring(F.col("text"), F.col("a"), F.lit(200)).alias("piece"), (F.col("a") + 200 > F.length("text")).alias("last")
    )
    return finished(stateful.guarded(pieces, Limits(window=1000, every=400, ratio=8.0)), "append")
