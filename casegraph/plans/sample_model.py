"""The data model over the sample tables, once as DataFrames and once as SQL for checking.

Orders play structured documents; customers, suppliers and parts are persons, organizations and
references; order and line rows are mentions. Texts come from ``documents``. Names that are matched
against registries have a code of their own for every customer, supplier and part, so they grow with
the tables; the registries are orders, which spell them in several ways.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegraph.operators.cooccurrence import cooccurrence, edges, with_stats
from casegraph.operators.traversal import with_layers
from casegraph.sources.lines import assign_dataset
from casegraph.workspace import scratch_dir, stored

ROOT = 1
MARKER = r"^DOC\d{8}$"


def code(kind: str, key: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(kind), F.col(key).cast("string"))), 1, 12)


# Names of customers, suppliers and parts: what stands before the code of the key, the code, and what follows.
CUSTOMER = (lambda: F.col("c_mktsegment"), lambda: code("c", "c_custkey"), lambda: F.lit(""))
SUPPLIER = (lambda: F.lit("Trading"), lambda: code("s", "s_suppkey"), lambda: F.lit("Inc"))
PART = (lambda: F.concat_ws(" ", "p_name", "p_brand"), lambda: code("p", "p_partkey"), lambda: F.lit(""))


def spelled(lead, own, tail, key: Column) -> Column:
    """A name in one of four ways, by ``key``: as it is, in capitals, with two characters or half of its code lost."""
    way = F.pmod(key, F.lit(4))

    def name(length: int) -> Column:
        return F.trim(F.concat_ws(" ", lead(), F.substring(own(), 1, length), tail()))

    return F.when(way == 1, F.upper(name(12))).when(way == 2, name(10)).when(way == 3, name(6)).otherwise(name(12))


def sql_spelled(lead: str, kind: str, own: str, tail: str, key: str) -> str:
    name = lambda n: f"trim({lead} || ' ' || substr(md5('{kind}' || {own}), 1, {n}) || ' {tail}')"
    return f"(CASE {key} % 4 WHEN 1 THEN upper({name(12)}) WHEN 2 THEN {name(10)} WHEN 3 THEN {name(6)} ELSE {name(12)} END)"


def sql_customer(key: str) -> str:
    return sql_spelled("c_mktsegment", "c", "c_custkey", "", key)


def sql_supplier(key: str) -> str:
    return sql_spelled("'Trading'", "s", "s_suppkey", "Inc", key)


def sql_part(key: str) -> str:
    return sql_spelled("p_name || ' ' || p_brand", "p", "p_partkey", "", key)


class SampleModel:
    """Tables of the data model for one folder of sample tables.

    Mention and entity tables are written once per model, as a real corpus would keep them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        docs = self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("DOC"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("doc_id"),
            F.col("o_orderpriority").alias("document_type"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("summary"),
            day.alias("date_earliest"), F.date_add(day, 30).alias("date_latest"),
            F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("failed").alias("analysis_status"),
        )
        return assign_dataset(docs)

    @cached_property
    def names(self) -> DataFrame:
        """(id, canonical_name, entity_type) of every entity."""
        customers = self.table("customer").select(
            (F.col("c_custkey") * 10 + 1).alias("id"), F.col("c_name").alias("canonical_name"),
            F.lit("person").alias("entity_type"))
        suppliers = self.table("supplier").select(
            (F.col("s_suppkey") * 10 + 2).alias("id"), F.col("s_name").alias("canonical_name"),
            F.lit("organization").alias("entity_type"))
        parts = self.table("part").select(
            (F.col("p_partkey") * 10 + 3).alias("id"),
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("canonical_name"),
            F.lit("reference").alias("entity_type"))
        return customers.unionByName(suppliers).unionByName(parts)

    @cached_property
    def occurrences(self) -> DataFrame:
        """(document_id, entity_id), one row per occurrence."""
        lines = self.table("lineitem")
        return (
            self.table("orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") * 10 + 1).alias("entity_id"))
            .unionByName(lines.select(
                F.col("l_orderkey").alias("document_id"),
                F.explode(F.array(F.col("l_suppkey") * 10 + 2, F.col("l_partkey") * 10 + 3)).alias("entity_id")))
        )

    @cached_property
    def mentions(self) -> DataFrame:
        counted = self.occurrences.groupBy("document_id", "entity_id").agg(
            F.count(F.lit(1)).cast("int").alias("mention_count"))
        return stored(counted, "mentions")

    @cached_property
    def entities(self) -> DataFrame:
        """Entities with document and connection counts."""
        return stored(with_stats(self.names, self.mentions), "entities")

    @cached_property
    def every_edge(self) -> DataFrame:
        """Pairs of entities that share a document."""
        return cooccurrence(self.mentions, 1)

    @cached_property
    def layered(self) -> DataFrame:
        """Entities with counts and layers."""
        return with_layers(self.entities, self.mentions, ROOT)

    @cached_property
    def network(self) -> DataFrame:
        """Weighted edges between people and organizations."""
        return stored(edges(self.mentions, self.entities), "edges")

    @cached_property
    def texts(self) -> DataFrame:
        """Text documents; a quality label marks a document as analysed."""
        labels = self.table("labels").select("doc_id", "quality")
        return self.table("documents").join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.col("text").alias("full_text"), "lang", "source", "n_chars",
            F.when(F.col("quality") == 1, "complete").when(F.col("quality") == 0, "failed")
            .otherwise("pending").alias("analysis_status"),
        )

    @cached_property
    def named(self) -> DataFrame:
        """Entities with a name of their own for every customer, supplier and part."""
        customers = self.table("customer").select(
            (F.col("c_custkey") * 10 + 1).alias("id"), spelled(*CUSTOMER, F.lit(0)).alias("canonical_name"), F.lit("person").alias("entity_type"),
            F.col("c_mktsegment").alias("source"), F.floor("c_acctbal").cast("bigint").alias("n_chars"))
        suppliers = self.table("supplier").select(
            (F.col("s_suppkey") * 10 + 2).alias("id"), spelled(*SUPPLIER, F.lit(0)).alias("canonical_name"), F.lit("organization").alias("entity_type"),
            F.lit("supplier").alias("source"), F.floor("s_acctbal").cast("bigint").alias("n_chars"))
        kind = F.when(F.col("p_type") == "ECONOMY", "location").when(F.col("p_type") == "SMALL", "organization").otherwise("person")
        parts = self.table("part").select(
            (F.col("p_partkey") * 10 + 3).alias("id"), spelled(*PART, F.lit(0)).alias("canonical_name"), kind.alias("entity_type"),
            F.col("p_brand").alias("source"), F.col("p_size").cast("bigint").alias("n_chars"))
        return customers.unionByName(suppliers).unionByName(parts)

    @cached_property
    def registries(self) -> dict[str, DataFrame]:
        """Three registries with a row for every order; a row spells the name of its customer, supplier or part in its own way."""
        key, amount = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(15,2)")
        suppliers, parts = self.table("supplier"), self.table("part")
        orders = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        loans = orders.where("o_orderstatus <> 'F'").join(suppliers, key % suppliers.count() == F.col("s_suppkey"))
        borrower = F.when(F.col("o_orderpriority") == "5-LOW", spelled(*SUPPLIER, key)).otherwise(spelled(*CUSTOMER, key))
        granted = self.table("orders").join(parts, key % parts.count() == F.col("p_partkey"))
        return {
            "ppp": loans.select(key.alias("id"), borrower.alias("borrower_name"), amount.alias("loan_amount"), F.col("o_orderpriority").alias("lender")),
            "fec": orders.where("o_orderstatus = 'F'").select(
                key.alias("id"), spelled(*CUSTOMER, key).alias("contributor_name"), amount.alias("amount"), F.col("o_orderpriority").alias("candidate_name")),
            "grants": granted.select(
                key.alias("id"), spelled(*PART, key).alias("recipient_name"), amount.alias("award_amount"), F.col("o_orderpriority").alias("awarding_agency")),
        }

    @cached_property
    def spellings(self) -> DataFrame:
        """(id, name, mentions): the name of every customer and the way in which each order spells it."""
        customers = self.table("customer")
        own = customers.select((F.col("c_custkey") * 10 + 1).alias("id"), spelled(*CUSTOMER, F.lit(0)).alias("name"), (F.col("c_custkey") % 7).alias("mentions"))
        orders = self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return own.unionByName(orders.select(
            (F.col("o_orderkey") * 10 + 5).alias("id"), spelled(*CUSTOMER, F.col("o_orderkey")).alias("name"), (F.col("o_orderkey") % 7).alias("mentions")))

    @cached_property
    def triples(self) -> DataFrame:
        lines = self.table("lineitem").join(
            self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        places = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        flag = F.col("l_returnflag")
        return lines.join(places, "l_suppkey").select(
            F.col("l_orderkey").alias("document_id"), (F.col("o_custkey") * 10 + 1).alias("subject_id"),
            F.when(flag == "R", "returned").when(flag == "A", "accepted").otherwise("ordered").alias("predicate"),
            (F.col("l_suppkey") * 10 + 2).alias("object_id"),
            (F.col("s_nationkey") * 10 + 4).cast("bigint").alias("location_id"),
            F.to_date("l_shipdate").alias("timestamp"), F.col("l_linenumber").alias("sequence_order"))

    @cached_property
    def hypotheses(self) -> DataFrame:
        """One hypothesis per order: its suppliers, a customer who need not be its own, nobody."""
        customers = self.table("customer").select("c_custkey", "c_name")
        guess = F.col("o_orderkey") % customers.count()
        claimed = self.table("orders").join(customers, guess == F.col("c_custkey"))
        suppliers = (
            self.table("lineitem").select("l_orderkey", "l_suppkey").distinct()
            .join(self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
            .groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("s_name")).alias("s"))
        )
        none = F.array().cast("array<string>")
        return claimed.join(suppliers, "o_orderkey", "left").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("Finding "), F.col("o_orderkey").cast("string")).alias("title"),
            F.lit("claimed link").alias("description"), F.col("o_orderpriority").alias("pattern_type"),
            F.concat(F.coalesce("s", none), F.array("c_name", F.lit("Nobody"))).alias("entity_names"),
            F.array(F.lit("listed together")).alias("evidence"), F.lit(0.5).alias("confidence"), "o_orderdate", "o_orderstatus")

    @cached_property
    def findings(self) -> DataFrame:
        from casegraph.sources.loading import save_findings

        extra = self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("discovered_at"),
            F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "P", "rejected")
            .otherwise("hypothesis").alias("status"))
        return save_findings(self.hypotheses, self.names).drop("status").join(extra, "id")

    @cached_property
    def answers(self) -> DataFrame:
        """(document_id, doc_id, response): analysis answers as JSON text, some of them faulty."""
        return self._answers(F.col("c_name"), F.col("s_name"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), F.col("n_name"))

    @cached_property
    def spelled_answers(self) -> DataFrame:
        """The same answers, where each order spells its customer in its own way."""
        way = F.pmod(F.col("o_orderkey"), F.lit(3))  # half of a code is too little to be told from others
        return self._answers(spelled(*CUSTOMER, way), spelled(*SUPPLIER, F.lit(0)), spelled(*PART, F.lit(0)), F.concat(F.lit("Port "), code("n", "n_nationkey")))

    def _answers(self, person: Column, organization: Column, part: Column, place: Column) -> DataFrame:
        lines = (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.array_sort(F.collect_list(F.struct(
                "l_linenumber", "l_suppkey", "l_partkey", organization.alias("s_name"), part.alias("part"),
                place.alias("n_name"), F.col("l_returnflag").alias("flag"),
                F.to_date("l_shipdate").cast("string").alias("day")))).alias("lines"))
        )
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, "o_orderkey", "left")
        faulty = lambda p: (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith(p)
        lines_col = F.coalesce("lines", F.expr(f"cast(array() as {dict(lines.dtypes)['lines']})"))
        day = F.to_date("o_orderdate").cast("string")
        customer = F.struct(
            person.alias("name"),
            F.when(faulty("1"), "alien").otherwise("person").alias("type"), F.lit("buyer").alias("context"))
        listed = F.flatten(F.transform(lines_col, lambda x: F.array(
            F.struct(x["s_name"].alias("name"), F.lit("organization").alias("type"), F.concat(F.lit("line "), x["l_linenumber"].cast("string")).alias("context")),
            F.struct(x["part"].alias("name"), F.lit("reference").alias("type"), F.concat(F.lit("line "), x["l_linenumber"].cast("string")).alias("context")))))
        triples = F.transform(lines_col, lambda x: F.struct(
            F.upper(person).alias("subject"), F.lit("person").alias("subjectType"), x["flag"].alias("predicate"),
            x["s_name"].alias("object"), F.lit("organization").alias("objectType"),
            x["n_name"].alias("location"), x["day"].alias("timestamp"), F.array(F.lit("trade")).alias("tags")))
        body = F.to_json(F.struct(
            F.when(~faulty("2"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("summary"),
            F.lit("An order.").alias("detailedSummary"), F.col("o_orderpriority").alias("documentType"),
            F.when(faulty("4"), "sometime").otherwise(day).alias("dateEarliest"), day.alias("dateLatest"),
            F.array("o_orderstatus").alias("contentTags"),
            F.concat(F.array(customer), listed).alias("entities"), triples.alias("triples")))
        answer = (
            F.when(faulty("3"), "I cannot answer that.")
            .when(F.col("o_orderstatus") == "F", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
            .otherwise(body)
        )
        return o.select(
            F.col("o_orderkey").alias("document_id"),
            F.concat(F.lit("DOC"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("doc_id"), answer.alias("response"))

    @cached_property
    def dump(self) -> str:
        """Folder with a line dump of the texts: first copies in one file set, repeats in a later one.

        Toxic documents start with an empty chunk; low-quality ones are repeated with another body.
        """
        folder = scratch_dir(self.spark, "dump")
        docs = self.table("documents").join(self.table("labels"), "doc_id", "left")
        marker = F.concat(F.lit("DOC"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
        empty = F.when(F.col("toxic") == 1, F.concat(marker, F.lit("\n"))).otherwise("")
        docs.select(F.concat(empty, F.lit("  "), marker, F.lit(" \n\n"), F.col("text"))).write.text(f"{folder}/a")
        docs.where("quality = 0").select(F.concat(marker, F.lit("\nREPEATED\n"))).write.text(f"{folder}/b")
        return f"{folder}/*"

    @cached_property
    def order_dump(self) -> str:
        """Folder with a line dump that has a document for every order."""
        folder = scratch_dir(self.spark, "order-dump")
        key = F.col("o_orderkey").cast("string")
        self.table("orders").select(F.concat(F.lit("DOC"), F.lpad(key, 8, "0"), F.lit("\nOrder "), key)).write.text(folder)
        return folder

    @cached_property
    def payments(self) -> DataFrame:
        """Customers pay the suppliers of an order on its day; suppliers pay returned lines back when they are shipped."""
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        customer, supplier = (F.col("o_custkey") * 10 + 1).alias("customer"), (F.col("l_suppkey") * 10 + 2).alias("supplier")
        amount = F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("decimal(15,2)").alias("amount")
        paid = lines.groupBy("o_orderkey", customer, supplier, F.to_date("o_orderdate").alias("day")).agg(amount)
        back = lines.where("l_returnflag = 'R'").groupBy("o_orderkey", customer, supplier, F.to_date("l_shipdate").alias("day")).agg(amount)
        return paid.select(
            F.concat_ws("-", F.lit("p"), "o_orderkey", "supplier").alias("payment"), F.col("customer").alias("payer"), F.col("supplier").alias("payee"), "day", "amount",
        ).unionByName(back.select(
            F.concat_ws("-", F.lit("r"), "o_orderkey", "supplier", "day").alias("payment"), F.col("supplier").alias("payer"), F.col("customer").alias("payee"), "day", "amount"))

    @cached_property
    def activity(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("entity_id"), "ts")


def _case(column: str) -> str:
    return (f"CASE WHEN {column} <= 3158 THEN 1 WHEN {column} <= 3857 THEN 2 WHEN {column} <= 5586 THEN 3 "
            f"WHEN {column} <= 8320 THEN 4 ELSE 5 END")


def sql_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def sql_trigrams(x: str) -> str:
    return (
        f"list_distinct(flatten(list_transform({sql_words(x)}, lambda w: "
        "list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::INT, 3)))))"
    )


def sql_similarity(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END)"


# Named table expressions, in an order in which each uses only earlier ones.
SQL = {
    "doc": f"""SELECT o_orderkey AS id, 'DOC' || lpad(o_orderkey::VARCHAR, 8, '0') AS doc_id,
        {_case('o_orderkey')} AS dataset_id, o_orderpriority AS document_type,
        'Order ' || o_orderkey AS summary, o_orderdate::DATE AS date_earliest,
        (o_orderdate::DATE + 30)::DATE AS date_latest,
        CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'failed' END AS analysis_status
        FROM orders""",
    "ent": """SELECT c_custkey * 10 + 1 AS id, c_name AS canonical_name, 'person' AS entity_type FROM customer
        UNION ALL SELECT s_suppkey * 10 + 2, s_name, 'organization' FROM supplier
        UNION ALL SELECT p_partkey * 10 + 3, p_name || ' ' || p_partkey, 'reference' FROM part""",
    "occ": """SELECT o_orderkey AS document_id, o_custkey * 10 + 1 AS entity_id FROM orders
        UNION ALL SELECT l_orderkey, l_suppkey * 10 + 2 FROM lineitem
        UNION ALL SELECT l_orderkey, l_partkey * 10 + 3 FROM lineitem""",
    "men": "SELECT document_id, entity_id, count(*)::INT AS mention_count FROM occ GROUP BY ALL",
    "pairs": """SELECT a.entity_id AS source, b.entity_id AS target, count(DISTINCT a.document_id) AS weight
        FROM men a JOIN men b ON a.document_id = b.document_id AND a.entity_id < b.entity_id GROUP BY ALL""",
    "sym": """SELECT source, target, weight FROM pairs UNION ALL SELECT target, source, weight FROM pairs""",
    "stats": """SELECT ent.*, coalesce(d.n, 0) AS document_count, coalesce(c.n, 0) AS connection_count FROM ent
        LEFT JOIN (SELECT entity_id, count(DISTINCT document_id) AS n FROM men GROUP BY 1) d ON d.entity_id = ent.id
        LEFT JOIN (SELECT source, count(*) AS n FROM sym GROUP BY 1) c ON c.source = ent.id""",
    "near": f"SELECT DISTINCT target AS id FROM sym WHERE source = {ROOT}",
    "layers": f"""SELECT id, CASE WHEN id = {ROOT} THEN 0 WHEN id IN (SELECT id FROM near) THEN 1
        WHEN id IN (SELECT target FROM sym WHERE source IN (SELECT id FROM near)) THEN 2 ELSE 3 END AS layer FROM ent""",
    "layered": "SELECT stats.*, layer FROM stats JOIN layers USING (id)",
    "eligible": "SELECT id FROM stats WHERE entity_type IN ('person', 'organization') AND connection_count >= 2",
    "net": """SELECT source, target, weight FROM pairs WHERE weight >= 2
        AND source IN (SELECT id FROM eligible) AND target IN (SELECT id FROM eligible)""",
    "netboth": "SELECT source, target, weight FROM net UNION ALL SELECT target, source, weight FROM net",
    "texts": """SELECT d.doc_id AS id, text AS full_text, lang, source, n_chars,
        CASE quality WHEN 1 THEN 'complete' WHEN 0 THEN 'failed' ELSE 'pending' END AS analysis_status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "named": f"""SELECT c_custkey * 10 + 1 AS id, {sql_customer('0')} AS canonical_name, 'person' AS entity_type, c_mktsegment AS source,
            floor(c_acctbal)::BIGINT AS n_chars FROM customer
        UNION ALL SELECT s_suppkey * 10 + 2, {sql_supplier('0')}, 'organization', 'supplier', floor(s_acctbal)::BIGINT FROM supplier
        UNION ALL SELECT p_partkey * 10 + 3, {sql_part('0')}, CASE p_type WHEN 'ECONOMY' THEN 'location' WHEN 'SMALL' THEN 'organization' ELSE 'person' END,
            p_brand, p_size::BIGINT FROM part""",
    "ppp": f"""SELECT o_orderkey AS id, CASE o_orderpriority WHEN '5-LOW' THEN {sql_supplier('o_orderkey')} ELSE {sql_customer('o_orderkey')} END AS borrower_name,
        o_totalprice::DECIMAL(15,2) AS loan_amount, o_orderpriority AS lender FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON o_orderkey % (SELECT count(*) FROM supplier) = s_suppkey WHERE o_orderstatus <> 'F'""",
    "fec": f"""SELECT o_orderkey AS id, {sql_customer('o_orderkey')} AS contributor_name, o_totalprice::DECIMAL(15,2) AS amount,
        o_orderpriority AS candidate_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
    "grants": f"""SELECT o_orderkey AS id, {sql_part('o_orderkey')} AS recipient_name, o_totalprice::DECIMAL(15,2) AS award_amount,
        o_orderpriority AS awarding_agency FROM orders JOIN part ON o_orderkey % (SELECT count(*) FROM part) = p_partkey""",
    "grams": f"""SELECT canonical_name, {sql_trigrams('canonical_name')} AS g FROM (SELECT canonical_name FROM named
        UNION SELECT borrower_name FROM ppp UNION SELECT contributor_name FROM fec UNION SELECT recipient_name FROM grants)""",
    "own_grams": f"""SELECT n, {sql_trigrams('n')} AS g FROM (SELECT DISTINCT lower(canonical_name) AS n FROM named)""",
    "listed_grams": f"""SELECT n, {sql_trigrams('n')} AS g FROM (SELECT lower(borrower_name) AS n FROM ppp
        UNION SELECT lower(contributor_name) FROM fec UNION SELECT lower(recipient_name) FROM grants)""",
    "alike": f"""SELECT a.n AS name1, b.n AS name2, {sql_similarity('a.g', 'b.g')} AS score FROM own_grams a JOIN listed_grams b
        ON len(a.g) * 10 >= len(b.g) * 7 AND len(b.g) * 10 >= len(a.g) * 7
        WHERE 17 * len(list_intersect(a.g, b.g)) >= 7 * (len(a.g) + len(b.g)) AND len(a.g) > 0""",
    "spelling": f"""SELECT c_custkey * 10 + 1 AS id, {sql_customer('0')} AS name, c_custkey % 7 AS n_chars FROM customer
        UNION ALL SELECT o_orderkey * 10 + 5, {sql_customer('o_orderkey')}, o_orderkey % 7 FROM orders JOIN customer ON o_custkey = c_custkey""",
    "short_grams": f"""SELECT n AS canonical_name, {sql_trigrams('n')} AS g FROM (SELECT DISTINCT lower(name) AS n FROM spelling)""",
    "short_alike": """SELECT a.canonical_name AS name1, b.canonical_name AS name2 FROM short_grams a JOIN short_grams b
        ON len(a.g) * 10 >= len(b.g) * 7 AND len(b.g) * 10 >= len(a.g) * 7
        WHERE 17 * len(list_intersect(a.g, b.g)) >= 7 * (len(a.g) + len(b.g)) AND len(a.g) > 0""",
    "trip": """SELECT l_orderkey AS document_id, o_custkey * 10 + 1 AS subject_id,
        CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'ordered' END AS predicate,
        l_suppkey * 10 + 2 AS object_id, s_nationkey * 10 + 4 AS location_id, l_shipdate::DATE AS timestamp,
        l_linenumber AS sequence_order
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "pay": """SELECT 'p-' || o_orderkey || '-' || (l_suppkey * 10 + 2) AS payment, o_custkey * 10 + 1 AS payer, l_suppkey * 10 + 2 AS payee,
            o_orderdate::DATE AS day, sum(l_extendedprice::DECIMAL(15,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
        UNION ALL SELECT 'r-' || o_orderkey || '-' || (l_suppkey * 10 + 2) || '-' || l_shipdate::DATE, l_suppkey * 10 + 2, o_custkey * 10 + 1,
            l_shipdate::DATE, sum(l_extendedprice::DECIMAL(15,2)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL""",
    "hyp": """SELECT o_orderkey AS id, c_custkey, o_orderpriority AS pattern_type, o_orderdate AS discovered_at,
        CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'P' THEN 'rejected' ELSE 'hypothesis' END AS status
        FROM orders JOIN customer ON o_orderkey % (SELECT count(*) FROM customer) = c_custkey""",
    "fent": """SELECT id AS finding_id, c_custkey * 10 + 1 AS entity_id FROM hyp
        UNION SELECT id, l_suppkey * 10 + 2 FROM hyp JOIN lineitem ON l_orderkey = id""",
    "good": """SELECT o_orderkey AS document_id, o_custkey, o_orderdate, o_orderpriority, o_orderstatus,
        CASE WHEN o_orderstatus <> 'P' OR o_orderpriority LIKE '5%' THEN NULL
        WHEN o_orderpriority LIKE '1%' THEN 'invalid field entities' WHEN o_orderpriority LIKE '2%' THEN 'invalid field summary'
        WHEN o_orderpriority LIKE '3%' THEN 'no JSON found' ELSE 'unparsable date' END AS error_message FROM orders""",
}


def with_sql(*names: str) -> str:
    """A WITH clause that defines the named tables and all they are built from."""
    import re

    needed: set[str] = set()

    def add(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in SQL:
                if other != name and re.search(rf"\b{other}\b", SQL[name]):
                    add(other)

    for name in names:
        add(name)
    order = [n for n in SQL if n in needed]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order) + "\n"
