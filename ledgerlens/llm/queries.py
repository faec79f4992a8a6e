"""The opN_ queries: thin digests of the operators over their whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat, cotraining, interaction, langid, licences, mixing, permutation, resampling, secrets, simhash, tokens
from ledgerlens.llm.common import table
from ledgerlens.llm.winnowing import find_contamination


def op1_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents and of their lines; a token belongs to the line of its first character."""
    found = tokens.attribute_tokens(table(spark, sf_dir, "documents"))
    counts = F.transform("sections", lambda s: s["tokens"])
    return found.select(
        "doc_id", "n_tokens", F.size("sections").cast("long").alias("n_lines"), "n_crossing", F.coalesce(F.array_max(counts), F.lit(0).cast("long")).alias("longest_line"), F.array_join(counts.cast("array<string>"), ",").alias("line_tokens")
    )


def op2_positional_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in documents."""
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    places = F.transform(base, lambda m: m["at"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["agreed"])), F.lit(0.0)).alias("score"),
    )


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 3, 1, 2 at 150 % of their words."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_event_sourced_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered with loss masks, as read back from the rendered text."""
    hard = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    out = chat.format_chats(chat.events_of_turns(turns.unionByName(own)))
    read = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return cotraining.classify_quality(docs, cotraining.fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents, by way of a new ledger of blobs."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: F.get(F.array(*[F.lit(r in secrets.BASE_RULES) for r in secrets.RULES]), s["rank"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return permutation.search(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in documents."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    away = langid.held_out()
    filters = langid.fit(docs.where(~away & F.col("doc_id").isNotNull()))
    return langid.identify(docs.select("doc_id", away.alias("held_out"), "text"), filters).drop("text")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over documents, in all orders, by language."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_inverted_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's distribution of words."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the documents' ids and of what they decode to."""
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")), text_col="decoded")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {
    "op1_offset_attribution": op1_offset_attribution,
    "op2_positional_licences": op2_positional_licences,
    "op3_sainte_lague_mix": op3_sainte_lague_mix,
    "op4_event_sourced_chats": op4_event_sourced_chats,
    "op5_cotrained_quality": op5_cotrained_quality,
    "op6_blob_ledger_secrets": op6_blob_ledger_secrets,
    "op7_permutation_index": op7_permutation_index,
    "op8_simhash_variants": op8_simhash_variants,
    "op9_winnowing_decontamination": op9_winnowing_decontamination,
    "op10_bitmask_language": op10_bitmask_language,
    "op11_filter_interaction": op11_filter_interaction,
    "op12_inverted_resampling": op12_inverted_resampling,
    "op13_streaming_bpe": op13_streaming_bpe,
}


def _interaction_sql() -> str:
    """Masks by string functions, orders by a recursion over the letters that are left."""
    letters = "".join(interaction.FILTERS)
    bit = lambda x: f"(1 << (strpos('{letters}', {x})::INT - 1))"
    return f"""
        WITH RECURSIVE x AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        y AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM x),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                     + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
              FROM y LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM o, unnest(string_split('{letters}', '')) AS u(f) WHERE strpos(filter_order, f) = 0),
        s AS (SELECT filter_order, step, filter_order[step] AS f, {bit("filter_order[step]")} AS own,
                     coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda z: CASE WHEN z = '' THEN 0 ELSE {bit("z")} END)), 0)::INT AS before
              FROM o, unnest(range(1, {len(letters) + 1})) AS v(step) WHERE length(filter_order) = {len(letters)}),
        r AS (SELECT part, filter_order, step, f,
                     coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
                     coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
                     coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
                     coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
              FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""


def _resampling_sql() -> str:
    """CRC-32 by its table, which the reflected polynomial gives; it is worked out once for each distinct word."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = resampling.BUCKETS
    return f"""
        WITH RECURSIVE steps(i, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) AS r(i)
                    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
        crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
        d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
        dw AS MATERIALIZED (SELECT rid, u.word AS word, count(*) AS n FROM d, unnest(w) AS u(word) GROUP BY ALL),
        bw AS MATERIALIZED (SELECT u.word AS word, count(*) AS n FROM (SELECT {words("text")} AS w FROM benchmark), unnest(w) AS u(word) GROUP BY ALL),
        v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        e AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda p: ('0x' || substr(h, 2 * p::INT + 1, 2))::BIGINT)),
                     lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % {n} AS bucket FROM v, crcs),
        s AS (SELECT bucket, sum(n) AS s FROM dw JOIN e USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN e USING (word) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {n})::DOUBLE
                     / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {n})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
        m AS (SELECT rid, sum(n * gain)::BIGINT AS total FROM dw JOIN e USING (word) JOIN g USING (bucket) GROUP BY rid),
        z AS (SELECT rid, doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) > 0 THEN floor(total::DOUBLE / len(w))::BIGINT ELSE 0 END AS weight,
                     ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
        q AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= {resampling.LEAST_WORDS} AS able FROM z),
        k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, rid) AS place, sum(able::INT) OVER () AS many FROM q)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= many * {resampling.PERCENT} // 100 THEN place END AS rank FROM k"""


def _secrets_sql() -> str:
    """The same rules by DuckDB's own pattern functions; places from the pieces between matches."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        # both cases written out, as (?i) folds letters beyond ASCII here: ſ would be an s
        pattern = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda x: f"[{x[0]}{x[0].upper()}]", m[1]) + ")", r.pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, rid, {rank} AS rank, '{r.kind}' AS kind, {r.min_length} AS least, "
            f"regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.measured}) AS g, regexp_split_to_array(t, '{pattern}') AS b FROM d"
        )
    return f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
        x AS ({" UNION ALL ".join(parts)}),
        y AS (SELECT rid, rank, kind, least, g[i] AS g, length(m[i]) AS long,
                     list_sum(list_transform(b[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda v: length(v))), 0) AS s
              FROM x, LATERAL unnest(range(1, len(m) + 1)) AS u(i)),
        z AS (SELECT rid, rank, kind, s, kind || ':' || s::BIGINT || ':' || (s + long)::BIGINT AS said FROM y WHERE length(g) >= least),
        a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(said, ',' ORDER BY s, rank) FILTER (rank < {len(secrets.BASE_RULES)}) AS base, string_agg(said, ',' ORDER BY s, rank) AS spans FROM z GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (rid)"""


ORACLE = {
    "op4_event_sourced_chats": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i))
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(4 + length(url_encode(role)) + 2 + length(text) + 9 + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op6_blob_ledger_secrets": _secrets_sql(),
    "op11_filter_interaction": _interaction_sql(),
    "op12_inverted_resampling": _resampling_sql(),
    "op9_winnowing_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
               FROM b, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
        dw AS (SELECT doc_id, i, k.n, array_to_string(w[i : i + k.n - 1], ' ') AS win
               FROM d, (SELECT DISTINCT n FROM bw) k, LATERAL unnest(range(1, len(w) - k.n + 2)) AS u(i)),
        h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h), LATERAL unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
