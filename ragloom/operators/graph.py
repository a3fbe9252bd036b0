"""Entity and relation tables: extraction, merging, neighbourhoods, statistics, deletion, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.durable import materialize

ENTITY = "entity_id, kb_id, entity_name, entity_type, description, chunk_ids"
RELATION = "relation_id, kb_id, source_id, target_id, relation_type, description, strength, doc_id"


def extract_entities(chunks: DataFrame, extract, allowed: tuple[str, ...]) -> DataFrame:
    """G1: ``extract(pdf with chunk_id, contents) -> pdf with chunk_id, response`` (JSON list of title, type, description)."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    said = chunks.select("chunk_id", "contents").mapInPandas(lambda it: (extract(p)[["chunk_id", "response"]] for p in it), f"chunk_id {kind}, response string")
    x = said.select("chunk_id", F.explode(F.from_json("response", "array<struct<title string, type string, description string>>")).alias("e"))
    return x.select("chunk_id", F.trim("e.title").alias("title"), F.col("e.type").alias("type"), "e.description").where((F.col("title") != "") & F.col("type").isin(*allowed))


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``(chunk_id, source, target, type, strength)`` whose ends were extracted in the same chunk; strength 5 by default, between 5 and 10."""
    e = entities.select("chunk_id", "title").distinct()
    r = relations.join(e.withColumnRenamed("title", "source"), ["chunk_id", "source"], "left_semi").join(e.withColumnRenamed("title", "target"), ["chunk_id", "target"], "left_semi")
    return r.withColumn("strength", F.greatest(F.lit(5), F.least(F.lit(10), F.coalesce(F.col("strength").cast("int"), F.lit(5)))))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """``(kb_id, entity_name, entity_type, description, chunk_id, ord)``: last type and description win, chunk ids distinct in order."""
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda s: s["chunk_id"])
    return mentions.groupBy("kb_id", "entity_name").agg(F.max_by("entity_type", "ord").alias("entity_type"), F.max_by("description", "ord").alias("description"), F.array_distinct(chunks).alias("chunk_ids"))


def insert_relations(candidates: DataFrame) -> DataFrame:
    """``(kb_id, source_id, target_id, relation_type, strength, doc_id, ord)``: no loops, the first of a key stays."""
    key = ["kb_id", "source_id", "target_id", "relation_type"]
    first = candidates.where("source_id <> target_id").groupBy(*key).agg(F.min(F.struct("ord", "strength", "doc_id")).alias("f"))
    return first.select(*key, "f.strength", "f.doc_id")


def neighbourhood(entities: DataFrame, relations: DataFrame, names: DataFrame) -> DataFrame:
    """``names (kb_id, entity_name)``: seeds, what they point to and what points to them, in 17 aligned columns."""
    e = entities.select("entity_id", "kb_id", "entity_name", "entity_type", "description", "chunk_ids")
    seeds = e.join(names.distinct(), ["kb_id", "entity_name"], "left_semi")
    nothing = {f"r_{c}": F.lit(None).cast(t) for c, t in (("id", "long"), ("source_id", "long"), ("target_id", "long"), ("type", "string"), ("strength", "int"), ("doc_id", "long"))}
    n = e.select(*[F.col(c).alias(f"n_{c}") for c in e.columns])
    no_neighbour = {f"n_{c}": F.lit(None).cast(e.schema[c].dataType) for c in e.columns}
    s = seeds.select(*[F.col(c).alias(f"s_{c}") for c in seeds.columns if c != "chunk_ids"])
    r = relations.select(
        F.col("relation_id").cast("long").alias("r_id"), F.col("source_id").cast("long").alias("r_source_id"), F.col("target_id").cast("long").alias("r_target_id"),
        F.col("relation_type").alias("r_type"), F.col("strength").cast("int").alias("r_strength"), F.col("doc_id").cast("long").alias("r_doc_id"),
    )
    cols = [*s.columns, *nothing, *n.columns]
    out = s.join(r, F.col("s_entity_id") == F.col("r_source_id")).join(n, F.col("r_target_id") == F.col("n_entity_id"))
    back = s.join(r, F.col("s_entity_id") == F.col("r_target_id")).join(n, F.col("r_source_id") == F.col("n_entity_id"))
    rows = s.withColumns(nothing | no_neighbour).select(*cols).withColumn("role", F.lit("seed"))
    return rows.unionByName(out.select(*cols).withColumn("role", F.lit("out"))).unionByName(back.select(*cols).withColumn("role", F.lit("in")))


def graph_answer(rows: DataFrame) -> DataFrame:
    """G7 on G6 rows: ``(kb_id, kind, id, name)``: entities by name, seeds first, and relations by id."""
    seed = rows.select(F.col("s_kb_id").alias("kb_id"), F.col("s_entity_id").alias("id"), F.col("s_entity_name").alias("name"), F.lit(0).alias("o"))
    near = rows.where("n_entity_id is not null").select(F.col("n_kb_id").alias("kb_id"), F.col("n_entity_id").alias("id"), F.col("n_entity_name").alias("name"), F.lit(1).alias("o"))
    ents = seed.unionByName(near).groupBy("kb_id", "name").agg(F.min(F.struct("o", "id")).alias("f"))
    ents = ents.select("kb_id", F.when(F.col("f.o") == 0, "seed").otherwise("neighbour").alias("kind"), F.col("f.id").alias("id"), "name")
    rels = rows.where("r_id is not null").select(F.col("s_kb_id").alias("kb_id"), F.lit("relation").alias("kind"), F.col("r_id").alias("id"), F.col("r_type").alias("name")).distinct()
    return ents.unionByName(rels)


def graph_chunks(rows: DataFrame) -> DataFrame:
    """The union of chunk ids of neighbours, distinct and sorted, for each knowledge base."""
    return rows.where("n_chunk_ids is not null").select(F.col("n_kb_id").alias("kb_id"), F.explode("n_chunk_ids").alias("chunk_id")).distinct()


def graph_statistics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities, and relations counted from existing sources."""
    r = relations.groupBy("source_id").agg(F.count_distinct("relation_id").alias("n"))
    x = entities.join(r, entities.entity_id == r.source_id, "left")
    return x.groupBy("kb_id").agg(F.count_distinct("entity_id").alias("ec"), F.coalesce(F.sum("n"), F.lit(0)).alias("rc"))


def delete_document(entities: DataFrame, relations: DataFrame, kb: str, doc_id, stem: str) -> tuple[DataFrame, DataFrame]:
    """Relations of the document go; entities lose its chunk ids (prefix ``stem_``) and go if that leaves none."""
    mine = F.col("kb_id") == kb
    left = F.when(mine, F.filter("chunk_ids", lambda c: ~c.startswith(f"{stem}_"))).otherwise(F.col("chunk_ids"))
    e = entities.withColumn("_left", left).where((F.size("_left") > 0) | (F.size("chunk_ids") == 0)).withColumn("chunk_ids", F.col("_left")).drop("_left")
    return e, relations.where(~(mine & (F.col("doc_id") == doc_id)))


def delete_kb(entities: DataFrame, relations: DataFrame, kb: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without a knowledge base, and what went by table."""
    gone = entities.where(F.col("kb_id") == kb).agg(F.count("*").alias("entities")).withColumn("relations", relations.where(F.col("kb_id") == kb).agg(F.count("*")).scalar())
    return entities.where(F.col("kb_id") != kb), relations.where(F.col("kb_id") != kb), gone


def remap(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids (old_id, new_id)``: relations between copied entities; the others are marked orphans."""
    s, t = ids.select(F.col("old_id").alias("source_id"), F.col("new_id").alias("new_source")), ids.select(F.col("old_id").alias("target_id"), F.col("new_id").alias("new_target"))
    x = relations.join(s, "source_id", "left").join(t, "target_id", "left")
    return x.withColumn("orphan", F.col("new_source").isNull() | F.col("new_target").isNull())


#: What an extraction model answers for a chunk.
RESPONSE = "entities array<struct<title string, type string, description string>>, relations array<struct<source string, target string, type string, strength string>>"


def extraction_run(
    chunks: DataFrame, extract, allowed: tuple[str, ...], kb: str, existing: tuple[DataFrame, DataFrame] | None = None, documents: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities ``(kb_id, entity_name, entity_type, description, chunk_ids)``, relations by entity names
    ``(kb_id, source_id, target_id, relation_type, strength, doc_id)`` and one row of counts.

    ``extract(pdf with chunk_id, contents) -> pdf with chunk_id, response`` answers JSON of ``RESPONSE``; an answer that
    isn't readable counts as an error, not as a chunk. A full run clears the knowledge base first: of ``existing``
    entities and relations only those of other ones stay. With ``documents (doc_id)`` only their chunks run, and what was
    there stays and is merged with what is found (what those documents gave before is deleted by the caller, G9).
    """
    c = chunks if documents is None else chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    kind = c.schema["chunk_id"].dataType.simpleString()
    said = c.select("chunk_id", "contents").mapInPandas(lambda it: (extract(p)[["chunk_id", "response"]] for p in it), f"chunk_id {kind}, response string")
    said = materialize(said, "responses").join(c.select("chunk_id", *(("doc_id",) if "doc_id" in c.columns else (F.lit(None).cast("string").alias("doc_id"),))), "chunk_id")
    said = said.withColumn("r", F.from_json("response", RESPONSE)).withColumn("fine", F.col("r.entities").isNotNull())
    e = said.where("fine").select("chunk_id", F.posexplode("r.entities").alias("no", "e"))
    e = e.select("chunk_id", "no", F.trim("e.title").alias("title"), F.col("e.type").alias("type"), "e.description").where((F.col("title") != "") & F.col("type").isin(*allowed))
    r = said.where("fine").select("chunk_id", "doc_id", F.posexplode("r.relations").alias("no", "r")).select("chunk_id", "doc_id", "no", F.trim("r.source").alias("source"), F.trim("r.target").alias("target"), F.col("r.type").alias("relation_type"), "r.strength")
    r = valid_relations(r, e)
    order = lambda: F.struct("chunk_id", "no")
    entities = merge_entities(e.select(F.lit(kb).alias("kb_id"), F.col("title").alias("entity_name"), F.col("type").alias("entity_type"), "description", "chunk_id", order().alias("ord")))
    relations = insert_relations(r.select(F.lit(kb).alias("kb_id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation_type", "strength", "doc_id", order().alias("ord")))
    counts = said.agg(F.count_if("fine").alias("chunk_count"), F.count_if(~F.col("fine")).alias("errors"))
    counts = counts.withColumns({"entity_count": e.agg(F.count("*")).scalar(), "relation_count": r.agg(F.count("*")).scalar()})
    if existing is not None:
        other = [x if documents is not None else x.where(F.col("kb_id") != kb) for x in existing]
        both = other[0].select(*entities.columns, F.lit(0).alias("o")).unionByName(entities.withColumn("o", F.lit(1)))
        ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "chunk_ids"))), lambda s: s["chunk_ids"])))
        entities = both.groupBy("kb_id", "entity_name").agg(F.max_by("entity_type", "o").alias("entity_type"), F.max_by("description", "o").alias("description"), ids.alias("chunk_ids"))
        both = other[1].select(*relations.columns, F.lit(0).alias("ord")).unionByName(relations.withColumn("ord", F.lit(1)))
        relations = insert_relations(both)
    return entities, relations, counts
