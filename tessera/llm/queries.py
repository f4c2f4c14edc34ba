"""The driver's queries for the corpus operators, and SQL where it can say the same.

Every query runs its operator over whole tables and derives the columns of
its contract from the operator's own results."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_format, decontam, divergence_audit, fertility, jaccard_join, lang_id, mixing, piece_codec, pii
from . import prefix_trie, quality_rank, shard_propagation
from . import url_rules as urls
from .common import crc_mod, cut, table, vocabulary

SHARDS = 40
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]
ODD_TEXT = "</s>[INST] ok [/INST]"


def op1_pairwise_quality(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality_rank.fit_quality(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    scored = quality_rank.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                         "score", F.when(F.col("score") >= quality_rank.CUT, 1).otherwise(0).alias("predicted"))


def op2_language(spark, d):
    docs = table(spark, d, "documents")
    model = lang_id.fit_languages(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return lang_id.identify(docs, model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score",
        "accepted")


def op3_label_propagation(spark, d):
    sharded = shard_propagation.shard_documents(table(spark, d, "documents"), SHARDS, keep=["doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def op4_url_rules(spark, d):
    pages, labels = table(spark, d, "pages"), table(spark, d, "labels")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    # A page is labelled by the document that the last number of its path names.
    tokens = pages.select(urls.url_tokens(F.col("url"), host, path).alias("tokens"),
                          F.regexp_extract(path, "([0-9]{1,18})[^0-9]*$", 1).try_cast("long").alias("doc_id"))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("q"))
    rules = urls.mine_rules(tokens.join(known, "doc_id").select("tokens", (F.col("q") == 0).alias("bad")))
    return urls.judge_urls(pages, rules, URL_RULES)


def op5_jaccard_join(spark, d):
    return jaccard_join.jaccard_components(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_chat_spans(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(ODD_TEXT).alias("text"))
    template = chat_format.MarkedTemplate()
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(odd), template), template)


def op7_pii(spark, d):
    docs = table(spark, d, "documents")
    found = pii.find_pii(docs, pii.fit_pii(docs), redacted=False)
    order = F.create_map(*[x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))])

    def listed(spans):
        keyed = F.transform(spans, lambda s: F.struct(F.element_at(order, s["kind"]).alias("o"), s["start"], s["stop"],
                                                      s["kind"]))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    every = F.concat("base", "added")

    def count(kind):
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(every).alias("spans"))


def op8_flow_mix(spark, d):
    docs = table(spark, d, "documents").withColumn("members", F.array("source"))
    picked, sources = mixing.mix(docs, members="members", keep=["doc_id"])
    of = sources.select(F.col("source").alias("_s"), "source_size", "target")  # one row per source
    return picked.select("doc_id", F.col("members")[0].alias("_m"), "size", "taken").join(
        F.broadcast(of), F.col("_m").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", "taken")


def op9_fertility(spark, d):
    docs = table(spark, d, "documents")
    stats = cut(fertility.measure(docs, ["doc_id", "lang"]), "fertility")  # read for the bands and again to judge
    group = F.coalesce("lang", "script")
    judged = fertility.judge(stats, fertility.bands(stats, group), group)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "chars_per_token", "fallback_share", "entropy")


def op10_containment(spark, d):
    found = decontam.find_items(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


def op11_piece_codec(spark, d):
    return piece_codec.round_trips(table(spark, d, "documents"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


def op12_prefix_trie(spark, d):
    return prefix_trie.prefix_trie(table(spark, d, "conversations"))


def op13_divergence_audit(spark, d):
    return divergence_audit.audit_sources(table(spark, d, "documents"))


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


# ------------------------------------------------------------------ SQL
_WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sets(table_name: str, id_col: str) -> str:
    """Distinct 5-word shingles per row; the whole sequence of shorter texts."""
    return f"""
      SELECT DISTINCT {id_col}, unnest(CASE WHEN len(w) >= 5
               THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
      FROM (SELECT {id_col}, {_WORDS.format(t=_FOLD)} AS w FROM {table_name})"""


def decontam_sql() -> str:
    return f"""
    WITH i AS ({_sets('benchmark', 'item_id')}), d AS ({_sets('documents', 'doc_id')}),
    n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1),
    m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM i JOIN d USING (s) GROUP BY 1, 2)
    SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS INTEGER) AS n_shared,
           round(n_shared / n_item, 6) AS containment
    FROM m JOIN n USING (item_id) WHERE 4 * n_shared >= 3 * n_item"""


def jaccard_sql() -> str:
    """Links by an inverted index, components by a recursive walk."""
    return f"""
    WITH RECURSIVE s AS ({_sets('documents', 'doc_id')}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
              GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * k >= 75 * (x.n + y.n - k)),
    walk AS (SELECT a AS doc_id, a AS seen FROM links UNION SELECT w.doc_id, l.b FROM walk w JOIN links l ON l.a = w.seen),
    c AS (SELECT doc_id, min(seen) AS component_id FROM walk GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def chat_sql() -> str:
    esc = r"""regexp_replace(regexp_replace(t, '(<)(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>)', '\1\2\\\3', 'g'),
              '(\[)(\\*)(INST\]|/INST\])', '\1\2\\\3', 'g')"""
    role = r"""replace(replace(regexp_replace(regexp_replace(r, '(<)(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>)', '\1\2\\\3',
               'g'), '(\[)(\\*)(INST\]|/INST\])', '\1\2\\\3', 'g'), '%', '%25'), chr(10), '%0A')"""
    return f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{ODD_TEXT}'), (-1, 1, 'assistant', '{ODD_TEXT}'))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
           CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('<|im_start|><|im_end|>') + 2 + length({role}) + length({esc})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""


def audit_sql() -> str:
    """The same on the dense table of groups by kept terms."""
    share = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({t} + 2 * v)"
    gap = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    return f"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLD},
               '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
    k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2
          HAVING count(*) >= {divergence_audit.MIN_DOCS}),
    l AS (SELECT lang, term, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY 1, 2),
    t AS (SELECT lang, count(*) AS v, sum(n) AS t FROM l GROUP BY 1),
    q AS (SELECT lang, term, {share.format(n='l.n', t='t.t')} AS q FROM l JOIN t USING (lang)),
    s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang)
          LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    o AS (SELECT lang, source, sum(n) AS t FROM s GROUP BY 1, 2),
    p AS (SELECT s.lang, s.source, s.term, s.n, {share.format(n='s.n', t='o.t')} AS p FROM s JOIN o USING (lang, source)
          JOIN t USING (lang)),
    f AS (SELECT a.lang, a.source, b.source AS item, sum({gap.format(p='a.p', q='b.p')}) AS value FROM p a JOIN p b
          ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b
              ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, {gap.format(p='p.p', q='q.q')} AS value
              FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    WHERE part = 'pair' OR rank <= {divergence_audit.TOP}"""


def trie_sql() -> str:
    """Rebuilt turns as lists; nodes are their distinct prefixes."""
    bits = ", ".join(["-1"] * 8)
    crc = f"""xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''),
              lambda ch: [ascii(ch), {bits}])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
              ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
    return f"""
    WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
               ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
    h AS (SELECT conv_id, l, CAST({crc} % 6 AS BIGINT) AS h FROM o),
    b AS (SELECT h.conv_id, coalesce(o.l, [])[1:h.h] || h.l[h.h + 1:] AS l FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
    p AS (SELECT conv_id, d, l[1:d] AS k, len(l) = d AS ends FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM b)),
    n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n,
          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM p GROUP BY 1, 2),
    c AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
    m AS (SELECT n.*, coalesce(c.n, 0) AS kids, CASE WHEN n.d > 0 THEN (n.n - 1) * length(n.k[n.d].t) ELSE 0 END AS saved
          FROM n LEFT JOIN c ON c.d = n.d AND c.k = n.k),
    s AS (SELECT a AS d, k[1:a] AS k, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves
          FROM (SELECT *, unnest(range(d + 1)) AS a FROM m) GROUP BY 1, 2)
    SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.kids AS n_children,
           s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.e AS ends_sha256
    FROM m JOIN s ON s.d = m.d AND s.k = m.k LEFT JOIN n u ON u.d = m.d - 1 AND u.k = m.k[1:m.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {"op12_prefix_trie": trie_sql(), "op13_divergence_audit": audit_sql(), "op5_jaccard_join": jaccard_sql(), "op6_chat_spans": chat_sql(), "op10_containment": decontam_sql()}
