"""Articles, vectors, requests and portfolios as views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import summary
from tidewire.operators.skew import hot_keys, sized, skew_join

FIRST_PUBLISHED_MS = 1_704_067_200_000
HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, for work that is heavy per row.

    Files with fewer splits than the cluster has cores are dealt out by key; a
    table of many files is read as it lies.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, df.columns[0])


def _published(doc_id: Column) -> Column:
    return F.lit(FIRST_PUBLISHED_MS) + doc_id * HOUR_MS


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the text form of the article table."""
    d = texts(spark, sf_dir, "documents")
    blank = F.lit("")
    published = _published(F.col("doc_id"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.date_format(F.timestamp_millis(published), "yyyy-MM-dd HH:mm:ss").alias("published_time"),
        F.split(F.col("text"), "\n", 2)[0].alias("title"),
        F.col("text").alias("introductory_paragraph"),
        blank.alias("descriptive_paragraph"),
        blank.alias("historical_context"),
        blank.alias("economyimpact"),
        blank.alias("impact_matrix"),
        blank.alias("perception_lines"),
        F.to_json(F.array("lang", "source")).alias("tags"),
        blank.alias("ai_image_prompt"),
        blank.alias("processed_at"),
        published.alias("published_time_unix"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table: three vectors per article, looked up by position.

    Some titles and summaries are empty and some stamps missing, as in rows
    indexed by older runs.
    """
    d = texts(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings")
    n = e.count()

    def named(slot: str, name: str) -> DataFrame:
        return e.select(F.col("vec_id").alias(slot), F.col("embedding").alias(name))

    doc = F.col("doc_id")
    first_line = F.split(F.col("text"), "\n", 2)[0]
    return (
        d.select(
            doc.cast("string").alias("article_id"),
            doc.alias("point_id"),
            F.when(doc % 7 == 0, "").otherwise(first_line).alias("title"),
            F.when(doc % 5 != 0, summary(F.col("text"))).alias("summary"),
            F.array("lang", "source").alias("tags"),
            F.when(doc % 11 != 0, _published(doc)).alias("timestamp"),
            (doc % n).alias("_t"),
            ((doc * 7 + 3) % n).alias("_d"),
            ((doc * 13 + 5) % n).alias("_g"),
        )
        .join(named("_t", "title_vec"), "_t")
        .join(named("_d", "description_vec"), "_d")
        .join(named("_g", "tags_vec"), "_g")
        .drop("_t", "_d", "_g")
    )


def last_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of each user; partial maxima keep busy users cheap."""
    clicks = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    latest = F.max(F.struct("ts", "event_id"))
    return clicks.groupBy("user_id").agg(latest["event_id"].alias("event_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user: the document clicked last, with derived filters.

    Users whose number divides by three ask for one source, by four for recent
    articles only, by five for the newest articles.
    """
    n_docs = table(spark, sf_dir, "documents").count()
    user = F.col("user_id")
    no_tags = F.array().cast("array<string>")
    source = F.array(F.concat(F.lit("src"), (user % 20).cast("string")))
    span_days = n_docs // 24 + 1
    return last_clicks(spark, sf_dir).select(
        user.cast("string").alias("request_id"),
        (F.col("event_id") % n_docs).alias("clicked_id"),
        F.when(user % 3 == 0, source).otherwise(no_tags).alias("categories"),
        F.when(user % 4 == 0, F.lit(span_days // 2 + 1)).cast("int").alias("days"),
        F.lit(FIRST_PUBLISHED_MS + n_docs * HOUR_MS).alias("as_of_ms"),
        (user % 5 == 0).alias("use_latest"),
    )


def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose query vector is the title vector of the clicked document.

    Adaptive execution splits the join where many users clicked one document.
    """
    e = table(spark, sf_dir, "embeddings")
    asked = requests(spark, sf_dir).withColumn("vec_id", F.col("clicked_id") % e.count())
    vectors = e.select("vec_id", F.col("embedding").alias("query_vec"))
    return asked.join(vectors, "vec_id").drop("vec_id")


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the clicked text and free-text interests.

    The interests are the first user turn of the conversation of that number.
    """
    asked = requests(spark, sf_dir)
    clicked = texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("clicked_id"), F.col("text").alias("clicked_news")
    )
    said = (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.min(F.struct("turn", "text"))["text"].alias("interests"))
        .select(F.col("conv_id").cast("string").alias("request_id"), "interests")
    )
    wanted = sized(asked.select("clicked_id").distinct())
    clicked = clicked.join(wanted, "clicked_id", "left_semi")
    hot = hot_keys(asked, "clicked_id")
    met = skew_join(asked, clicked, "clicked_id", "left", ["request_id"], hot)
    return met.join(said, "request_id", "left")


def _holding_account(key: Column, holdings: Column) -> Column:
    """An account as JSON text; a lone holding is an object and not a list."""
    body = F.when(F.size(holdings) == 1, F.to_json(holdings[0])).otherwise(F.to_json(holdings))
    return F.concat(
        F.lit('"'), key, F.lit('":{"summary":{"investment":{"holdings":{"holding":'), body, F.lit("}}}}")
    )


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio document per customer.

    Equities are the parts ordered: an account per order and a holding per line. Some
    customers also hold funds, insurance and deposits, and one in eleven has nothing but
    white space.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    held = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linenumber")
        .join(parts, "l_partkey")
        .join(orders, "l_orderkey")
        .select(
            "o_custkey", F.col("l_orderkey").alias("order"), "p_name", "p_type",
            F.struct("l_linenumber", "l_partkey").alias("line"),
        )
    )
    holding = F.struct(F.col("p_name").alias("issuerName"), F.col("p_type").alias("description"))
    accounts = (
        held.groupBy("o_custkey", "order")
        .agg(F.sort_array(F.collect_list(F.struct("line", holding.alias("h")))).alias("hs"))
        .select("o_custkey", "order", F.transform("hs", lambda x: x["h"]).alias("holdings"))
    )
    account = _holding_account(F.concat(F.lit("E"), F.col("order").cast("string")), F.col("holdings"))
    equities = (
        accounts.select("o_custkey", F.struct("order", account.alias("json")).alias("a"))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sort_array(F.collect_list("a")).alias("accounts"))
        .select(
            "c_custkey",
            F.concat(
                F.lit('"EQUITIES":{'),
                F.array_join(F.transform("accounts", lambda a: a["json"]), ","),
                F.lit("}"),
            ).alias("equities"),
        )
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    cust = F.col("c_custkey")
    fund = F.array(
        F.struct(
            F.when(cust % 4 == 0, "").otherwise(F.col("n_name")).alias("amc"),
            F.col("n_name").alias("issuerName"),
            F.col("c_mktsegment").alias("schemeCode"),
        )
    )
    policy = F.to_json(
        F.struct(
            F.col("c_name").alias("policyName"),
            F.concat(F.lit("TERM_"), F.col("c_mktsegment")).alias("policyType"),
            F.lit("LIFE").alias("coverType"),
        )
    )
    deposit = F.to_json(
        F.struct(
            F.lit("SAVINGS").alias("accountType"),
            F.lit("null").alias("facility"),
            F.col("c_mktsegment").alias("description"),
        )
    )
    blank = cust % 11 == 0
    sections = F.array(
        F.when(cust % 5 == 0, F.concat(F.lit('"DEPOSIT_V2":{"summary":['), deposit, F.lit("]}"))),
        F.when(cust % 3 == 0, F.concat(
            F.lit('"INSURANCE_POLICIES":{"p":{"summary":'), policy, F.lit("}}"))),
        F.when(cust % 2 == 0, F.concat(
            F.lit('"MUTUALFUNDS":{'), _holding_account(F.lit("m"), fund), F.lit("}"))),
        F.col("equities"),
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nations, "c_nationkey")
        .join(equities, "c_custkey", "left")
        .select(
            cust.cast("string").alias("request_id"),
            F.when(blank, "{}").otherwise(F.concat(F.lit("{"), F.array_join(sections, ","), F.lit("}"))).alias("portfolio"),
            F.when(blank, "\t\n").when(cust % 7 == 0, "\n\tgold \n").otherwise("").alias("interests"),
        )
    )


def trust_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of plans and trusts, their sections in another order than texts take."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    cust = F.col("c_custkey")
    plan = F.array(
        F.struct(
            F.when(cust % 4 == 0, "").otherwise(F.col("n_name")).alias("amc"),
            F.col("n_name").alias("issuerName"), F.col("c_mktsegment").alias("schemeCode"),
        )
    )
    estates = F.array(F.struct(F.col("n_name").alias("issuerName")), F.struct(F.col("c_mktsegment").alias("issuerName")))
    roads = F.array(F.struct(F.col("c_name").alias("issuerName")), F.struct(F.lit("null").alias("issuerName")))
    sections = F.array(
        F.when(cust % 5 == 0, F.concat(F.lit('"INVIT":{'), _holding_account(F.lit("i"), roads), F.lit("}"))),
        F.when(cust % 2 == 0, F.concat(F.lit('"SIP":{'), _holding_account(F.lit("s"), plan), F.lit("}"))),
        F.when(cust % 3 == 0, F.concat(F.lit('"REIT":{'), _holding_account(F.lit("r"), estates), F.lit("}"))),
    )
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        cust.cast("string").alias("request_id"), F.concat(F.lit("{"), F.array_join(sections, ","), F.lit("}")).alias("portfolio"),
        F.lit(None).cast("string").alias("interests"),
    )


def stored_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An incoming batch, and the two stores it meets.

    The article store holds every second document and the vector store every
    third. The batch is all documents; every tenth comes twice, the later time
    with a mark on its title.
    """
    a = articles(spark, sf_dir).withColumn("_seq", F.col("id").cast("bigint"))
    again = a.where(F.col("_seq") % 10 == 0).withColumns(
        {"title": F.concat("title", F.lit("*")), "_seq": F.col("_seq") + 1_000_000_000_000}
    )
    d = table(spark, sf_dir, "documents").select("doc_id")
    article_store = d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"))
    vector_store = d.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("article_id"))
    return a.unionByName(again), article_store, vector_store
