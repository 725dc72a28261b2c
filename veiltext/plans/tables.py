"""The tables queries run on: the given ones and those derived from them.

`NOTES` is one SQL text for Spark and for the oracle. It turns orders into short notes in which
every pattern occurs, with overlapping findings and all kinds of white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = """
select o_orderkey as doc_id,
  concat('Zenith', o_custkey % 50, '.', case o_orderkey % 6 when 0 then 'txt' when 1 then 'pdf'
    when 2 then 'xlsx' when 3 then 'PPTX' when 4 then 'docx' else 'v2.txt' end) as file_name,
  concat(
    'Ticket ', o_orderkey, ' for zenith', o_custkey % 50, '  opened', chr(9), 'by ',
    case o_custkey % 9 when 0 then 'Ada Lovelace' when 1 then 'Grace Hopper'
      when 2 then 'Alan Turing' when 3 then concat('Maria', chr(9), 'del  CARMEN Lopez y Vega')
      when 4 then 'J. R. Smith' when 5 then concat(chr(39), 'Abd al-Rahman')
      when 6 then 'Jean-Luc O''Neil, Jr.' when 7 then 'Adam Lovelace' else 'Time In' end, '.', chr(13), chr(10),
    'Write to user', o_custkey, '@mail', o_custkey % 7, '.example.com or call +1 (',
    200 + o_custkey % 800, ') 555-', lpad(cast(o_orderkey % 10000 as string), 4, '0'), '.',
    chr(10), chr(10), chr(10),
    case o_orderkey % 5
      when 0 then concat('SSN ', lpad(cast(o_custkey % 1000 as string), 3, '0'), '-',
        lpad(cast(o_orderkey % 100 as string), 2, '0'), '-',
        lpad(cast(o_orderkey % 10000 as string), 4, '0'), ' and call 555-123-',
        lpad(cast(o_orderkey % 10000 as string), 4, '0'), ' alias 123-45-6789@id.example.com! ')
      when 1 then concat('Id ', lpad(cast(o_custkey % 10000 as string), 4, '0'),
        case when o_orderkey % 10 = 1 then '5678' else ' 5678 ' end,
        lpad(cast(o_orderkey % 10000 as string), 4, '0'), ' with card 4111 1111 1111 1111! ')
      when 2 then concat('Camera rtsp://10.0.', o_custkey % 256, '.', o_orderkey % 256,
        ':RTSP and 192.168.1.', o_orderkey % 300, '/24 at 00:1A:2B:3C:4D:5E! ')
      when 3 then concat('Visit ', 1 + o_custkey % 999, ' Main Street Springfield IL 62704 on ',
        month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), '! ')
      else concat('Licence AB', 1000000 + o_orderkey, ' passport C', 10000000 + o_orderkey, '! ')
      end,
    case o_orderkey % 7
      when 0 then 'Firewall rules allow from 10.0.* and inbound deny on port 443, tcp deny elsewhere. '
      when 1 then 'The role admin-ops has admin access and write permission under policy v2. '
      when 2 then 'Authentication required, login required and mfa enabled by the customer. '
      when 3 then 'The password policy sets min length, complexity enforced for Global Tech Solutions. '
      when 4 then 'Encryption enabled with AES 256 and TLS, certificate rotated at Acme Corporation. '
      when 5 then 'A vulnerability found in CVE-2024-1234 with risk level high. '
      else 'Nothing of note happened during this quiet and uneventful review. ' end,
    case o_custkey % 3 when 0
      then 'Fingerprint logs are kept on paper with a timestamp and backup.'
      when 1 then 'Ok.' else '' end) as text{extra}
from {orders}
"""
NAMES = (
    "Ada", "Ada Lovelace", "Grace Hopper", "Alan  Turing", "Time In", "Cadence",
    "Maria del Carmen Lopez y Vega", "del Carmen Lopez", "J. R. Smith", "'Abd al-Rahman",
    "Jean-Luc O'Neil, Jr.", "Lovelace,",
)


def notes_sql(extra: str = "") -> str:
    """The notes query, still with its `{orders}` place, and further columns of orders."""
    return NOTES.replace("{extra}", extra)


# Rows that one task takes when a table is dealt out: an order becomes a note, a document is long.
ROWS_A_TASK = {"documents": 2_000}
NARROW_ROWS_A_TASK = 25_000
# So many files a core keep all cores busy up to the end.
FILES_A_CORE = 4


def _shares(table: DataFrame, rows: int) -> int:
    return max(1, -(-table.count() // rows))


class Tables:
    """The input tables under one folder, and the derived ones.

    A file with a single row group is read by a single task, and so is all that is derived from its
    rows. So a table in fewer files than its rows are worth tasks is dealt out evenly behind the scan; the
    texts of documents only if there are fewer than `FILES_A_CORE` files a core. `partitions` says how many
    tasks instead.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int | None = None) -> None:
        self.spark = spark
        self.folder = folder
        self.partitions = partitions

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        tasks = self.partitions or self._tasks(name, table)
        return table.repartition(tasks) if tasks else table

    def _tasks(self, name: str, table: DataFrame) -> int:
        """Over how many tasks to deal a table out, 0 to leave it as it is. The rows are counted from the
        files' footers."""
        files = len(table.inputFiles())
        if name in ROWS_A_TASK and files >= FILES_A_CORE * self.spark.sparkContext.defaultParallelism:
            return 0
        tasks = _shares(table, ROWS_A_TASK.get(name, NARROW_ROWS_A_TASK))
        return tasks if tasks > files else 0

    def tasks(self, *names: str) -> int:
        """How many tasks the tables' rows are worth, in whatever files they are."""
        return sum(
            _shares(
                self.spark.read.parquet(f"{self.folder}/{name}.parquet"),
                ROWS_A_TASK.get(name, NARROW_ROWS_A_TASK),
            ) for name in names
        )

    def notes(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return self.spark.sql(notes_sql(), orders=orders)

    def documents(self) -> DataFrame:
        docs = self.read("documents").select("doc_id", "text", "source")
        name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return docs.select("doc_id", name.alias("file_name"), "text")

    def corpus(self) -> DataFrame:
        """Notes and documents together; documents are numbered downwards from -1."""
        docs = self.documents().withColumn("doc_id", F.lit(-1).cast("bigint") - F.col("doc_id"))
        return self.notes().unionByName(docs)

    def files(self) -> DataFrame:
        return self.corpus().select(
            "doc_id", "file_name", F.octet_length("text").cast("bigint").alias("length")
        )

    def note_pages(self) -> DataFrame:
        """Notes and documents cut into pages at sentence ends."""
        pieces = F.split(F.col("text"), r"(?<=[.!?])\s+")
        return (
            self.corpus().select("doc_id", F.posexplode(pieces).alias("pos", "text"))
            .filter(F.col("text") != "")
            .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("page_no"), "text")
        )

    def ocr_words(self) -> DataFrame:
        """Notes as OCR output: words in lines of eight, with boxes and confidences."""
        words = self.notes().select(
            "doc_id", F.posexplode(F.split(F.col("text"), r"\s+")).alias("pos", "text")
        )
        pos = F.col("pos")
        return words.select(
            F.col("doc_id").alias("image_id"), pos.cast("bigint").alias("word_no"), "text",
            ((F.col("doc_id") * 31 + pos * 17) % 100).cast("int").alias("conf"),
            (60 * (pos % 8)).cast("int").alias("left"),
            (20 * F.floor(pos / 8)).cast("int").alias("top"),
            (10 * F.length("text")).cast("int").alias("width"),
            F.lit(16).alias("height"),
        )

    def units(self) -> DataFrame:
        """Conversation turns as the units of a document; user turns stand for table cells."""
        turns = self.read("conversations")
        kind = F.when(F.col("role") == "user", "cell").otherwise("paragraph")
        return turns.select(
            F.col("conv_id").alias("doc_id"), kind.alias("unit_kind"),
            F.col("turn").alias("unit_no"), "text",
        )

    def note_units(self) -> DataFrame:
        """Pages as slide units: even ones are cells, and every tenth is only a label."""
        no = F.col("page_no")
        label = F.when((F.col("doc_id") + no) % 10 == 0, " Time In ").otherwise(F.col("text"))
        return self.note_pages().select(
            "doc_id", F.when(no % 2 == 0, "cell").otherwise("paragraph").alias("unit_kind"),
            no.alias("unit_no"), label.alias("text"),
        )

    def cells(self) -> DataFrame:
        """Orders as workbooks: one per customer, one sheet per priority, one row per order."""
        orders = self.read("orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
        )
        wide = self.spark.sql(
            notes_sql(", o_custkey, o_orderkey, o_orderpriority"), orders=orders
        )
        cell = F.array(
            F.struct(F.lit(0).alias("col_no"), F.lit("file").alias("col"),
                     F.col("file_name").alias("value")),
            F.struct(F.lit(1).alias("col_no"), F.lit("note").alias("col"),
                     F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("value")),
            F.struct(F.lit(2).alias("col_no"), F.lit("label").alias("col"),
                     F.when(F.col("doc_id") % 2 == 0, "Time In").otherwise("  ").alias("value")),
        )
        return wide.select(
            F.col("o_custkey").alias("doc_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("sheet_no"),
            F.col("o_orderpriority").alias("sheet"),
            F.col("o_orderkey").alias("row"),
            F.inline(cell),
        )

    def grid(self) -> DataFrame:
        """A wide table with a null, a blank and a label among its cells."""
        doc = F.col("doc_id")
        return self.notes().select(
            doc, "file_name",
            F.when(doc % 9 != 0, F.col("text")).alias("note"),
            F.when(doc % 2 == 0, " time in ").otherwise("  ").alias("label"),
            F.concat(F.lit(" user"), doc.cast("string"), F.lit("@x.org ")).alias("contact"),
        )

    def names(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in NAMES], "name string")

    def places(self) -> DataFrame:
        return self.read("nation").select(F.col("n_name").alias("name")).unionByName(
            self.read("region").select(F.col("r_name").alias("name"))
        )

    def place_docs(self) -> DataFrame:
        """Customers as short texts that name their nation and region."""
        customer = self.read("customer").select("c_custkey", "c_name", "c_nationkey")
        return (
            customer.join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("doc_id"),
                F.concat(
                    F.col("c_name"), F.lit(" moved from "), F.initcap("n_name"), F.lit(" (in "),
                    F.lower("r_name"), F.lit(") to "), "n_name", F.lit("."),
                ).alias("text"),
            )
        )

    def responses(self) -> DataFrame:
        """Offline answers: none for every third document, empty for every fifth."""
        doc = F.col("doc_id")
        return self.corpus().filter(doc % 3 != 0).select(
            doc, F.when(doc % 5 == 0, "").otherwise(
                F.concat(F.lit("Summary of document "), doc.cast("string"))
            ).alias("response"),
        )
