"""One query for each operator over its whole table, and the SQL they have to agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, conversations, jaccard, language, manifest, mixing, neardup, neighbours, quality, repeats, secrets, topk, toxicity
from sievework.llm.common import label_split, scratch
from sievework.llm.registry import query, table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _secret_sql() -> str:
    """Spans from the pieces between matches, kind by kind, then the digests."""

    def spans(rule: secrets.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        size = f"length(regexp_extract(m[i], '{pattern}', {rule.group}))" if rule.group else "length(m[i])"
        return f"""
            SELECT doc_id, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN {size} >= {rule.least} THEN
                {{'pos': list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::BIGINT, 'n': length(m[i])}} END), lambda x: x IS NOT NULL)) AS s
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS p FROM documents)"""

    kinds = {r.kind: i for i, r in enumerate(secrets.RULES)}
    place = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in kinds.items()) + " END"
    return f"""
        WITH found AS ({" UNION ALL ".join(map(spans, secrets.RULES))}),
        named AS (SELECT doc_id, kind, s.pos AS pos, {place} AS place, kind || ':' || s.pos || ':' || (s.pos + s.n) AS span FROM found),
        digest AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(span, ',' ORDER BY pos, place) AS spans FROM named GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN digest USING (doc_id)"""


@query("op1_secret_scans", _secret_sql())
def op1_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document: the texts are the versions of a ledger that starts empty.

    The ledger's rules are the base kinds, so all spans are base spans.
    """
    versions = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    ledger = secrets.BlobLedger(spark, scratch(spark, "secret-ledger"))
    ledger.scan(versions)
    found = ledger.findings(versions)
    kinds = F.array(*[F.lit(r.kind) for r in secrets.RULES])
    count = lambda i: F.size(F.filter("findings", lambda f: f["kind"] == i)).cast("long")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", kinds[f["kind"]], f["start"], f["end"])), ",")
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.RULES)], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


@query("op2_repeats")
def op2_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every document that lie in a 400-byte string which occurs again."""
    return repeats.remove(table(spark, sf, "documents").select("doc_id", "text"))


MIXING_SQL = """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
    totals AS (
        SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM sized GROUP BY source),
    ranked AS (
        SELECT *, sum(source_size) OVER () AS whole, sum(w) OVER () AS whole_w,
            coalesce(sum(source_size) OVER before, 0) * 3 AS held, coalesce(sum(w) OVER before, 0) AS held_w
        FROM totals WINDOW before AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levels AS (SELECT *, (whole - held)::DOUBLE / (whole_w - held_w)::DOUBLE AS level FROM ranked),
    chosen AS (SELECT *, max(CASE WHEN level * w::DOUBLE <= source_size * 3 THEN level END) OVER () AS lam FROM levels),
    aimed AS (
        SELECT source, source_size, CASE WHEN lam IS NULL THEN (source_size * 3)::DOUBLE ELSE least(lam * w::DOUBLE, (source_size * 3)::DOUBLE) END AS target FROM chosen),
    parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM aimed),
    steps AS (
        SELECT source, h, sum(size)::BIGINT AS n FROM sized GROUP BY source, h),
    middles AS (SELECT source, h, sum(n) OVER (PARTITION BY source ORDER BY h) - n + n / 2 AS middle FROM steps)
    SELECT d.doc_id, d.size, p.source_size, p.target,
        d.size * (p.passes + CASE WHEN p.target - p.passes * p.source_size > 0 AND m.middle <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END) AS taken
    FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN middles m ON d.source IS NOT DISTINCT FROM m.source AND d.h = m.h"""


@query("op3_mixing", MIXING_SQL)
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    mix = mixing.Mixture(table(spark, sf, "documents"))
    return mix.documents().select("doc_id", "size", "source_size", "target", "taken")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary_path(), decoded="decoded")
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


TOPK_SQL = """
    WITH ints AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query("op5_topk", TOPK_SQL)
def op5_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    vectors = table(spark, sf, "embeddings").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("ints"), "embedding").filter(topk.usable(F.col("embedding")))
    return topk.search(vectors, F.col("vec_id") % 20 == 0)


@query("op6_quality")
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document; rows of one quarter are held out of the fit."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (label_split(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@query("op8_language")
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; rows of one fifth are held out of the fit."""
    docs = table(spark, sf, "documents")
    model = language.train(docs.select("doc_id", "text", "lang"))
    said = language.predict(docs.select("doc_id", "text", (label_split(F.col("doc_id"), 5) == 0).alias("held_out")), model)
    return said.select("doc_id", "held_out", "lang_pred", "score")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document; rows of one fifth are held out of the fit."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", label_split(F.col("doc_id"), 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth one."""
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, from the polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    byte = f"list_reduce(range(8)::BIGINT[], lambda c, k: {step}, xor(crc, b) & 255)"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda crc, b: xor({byte}, crc >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


def _manifest_sql() -> str:
    """Level by level: the trees of all languages, the tree over them, then every leaf's siblings and fold."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
    hashed = lambda chars: "sha256(" + " || ".join(part(chars if c == "n_chars" else c) for c in manifest.FIELDS) + ")"

    def tree(name: str) -> str:
        return f"""{name}_tree AS (
            SELECT 0 AS level, g, pos, hash, nodes FROM {name}_leaves
            UNION ALL
            SELECT any_value(level) + 1, g, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(nodes) + 1) // 2 FROM {name}_tree WHERE nodes > 1 GROUP BY g, pos // 2)"""

    def path(name: str) -> str:
        return f"""{name}_path AS (
            SELECT l.g, l.pos, t.level, t.pos % 2 = 1 AS after, coalesce(s.hash, '') AS sibling
            FROM {name}_leaves l JOIN {name}_tree t ON t.g = l.g AND t.pos = l.pos // (1 << t.level) AND t.nodes > 1
            LEFT JOIN {name}_tree s ON s.g = t.g AND s.level = t.level AND s.pos = xor(t.pos, 1))"""

    return f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('1' || lang, '0') AS g, {hashed("n_chars")} AS hash,
                CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {hashed("n_chars + 1")} END AS found FROM documents),
        docs_leaves AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY g) AS nodes FROM leaves),
        {tree("docs")},
        tops_leaves AS (
            SELECT '' AS g, g AS of, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS nodes FROM docs_tree WHERE nodes = 1),
        {tree("tops")}, {path("docs")}, {path("tops")},
        steps AS (
            SELECT l.g, l.pos, p.level, p.after, p.sibling FROM docs_leaves l JOIN docs_path p ON p.g = l.g AND p.pos = l.pos
            UNION ALL
            SELECT l.g, l.pos, 1000 + p.level, p.after, p.sibling FROM docs_leaves l JOIN tops_leaves o ON o.of = l.g JOIN tops_path p ON p.pos = o.pos),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY level) AS step FROM steps),
        folds AS (
            SELECT g, pos, 0::BIGINT AS step, coalesce(found, hash) AS value FROM docs_leaves
            UNION ALL
            SELECT f.g, f.pos, f.step + 1, sha256(CASE WHEN n.after THEN n.sibling || f.value ELSE f.value || n.sibling END)
            FROM folds f JOIN numbered n ON n.g = f.g AND n.pos = f.pos AND n.step = f.step + 1),
        folded AS (SELECT g, pos, arg_max(value, step) AS folded_root FROM folds GROUP BY g, pos),
        proofs AS (SELECT g, pos, string_agg(sibling, '' ORDER BY step) AS proof FROM numbered GROUP BY g, pos),
        whole AS (SELECT hash AS root FROM tops_tree WHERE nodes = 1)
        SELECT l.doc_id, l.hash AS leaf, o.hash AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM docs_leaves l JOIN tops_leaves o ON o.of = l.g JOIN folded f ON f.g = l.g AND f.pos = l.pos LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos, whole"""


@query("op11_manifest", _manifest_sql())
def op11_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A Merkle manifest of all documents by language; a seventh of the rows is checked with a changed ``n_chars``."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest.manifest(table(spark, sf, "documents"), tampered={"n_chars": F.col("n_chars").cast("long") + 1}, when=chosen)
    return made.withColumnRenamed("id", "doc_id").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _repair_sql() -> str:
    """Damage, faults, then a recursive step for each row that keeps the best (cost, audit) of four places in the grammar."""
    best = lambda *ways: "list_sort(list_filter([" + ", ".join(ways) + "], lambda x: x IS NOT NULL))[1]"

    def way(state: str, cost: str, letter: str, piece: str, test: str = "true") -> str:
        return f"CASE WHEN {test} AND {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {piece}}} END"

    deleted = lambda s: way(s, "2", "D", "''")
    kept = lambda s, initial: way(s, "more", "K", "chr(10) || role || ':' || text", f"edit AND role[1] = '{initial}'")
    given = lambda s, role: way(s, "1 + more", "R", f"chr(10) || '{role}:' || text", "edit")
    inserted = lambda s, role: way(s, "5", "I", f"chr(10) || '{role}:'")
    # Places: n nothing yet, s after the system's row, u after the user's, a after the assistant's.
    row = {
        "n": best(deleted("n")),
        "s": best(deleted("s"), kept("n", "s")),
        "u": best(deleted("u"), *[w for p in "nsa" for w in (kept(p, "u"), given(p, "user"))]),
        "a": best(deleted("a"), kept("u", "a"), given("u", "assistant")),
    }
    closed_u = best("u", *[inserted(p, "user") for p in "nsa"])
    rows = ", ".join(f"{expression} AS {name}" for name, expression in row.items())
    then = lambda source: f"SELECT * REPLACE ({best('a', inserted('u', 'assistant'))} AS a) FROM (SELECT * REPLACE ({closed_u} AS u) FROM ({source}))"
    state = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
    first = f"SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'o': ''}}::{state} AS n, NULL::{state} AS s, NULL::{state} AS u, NULL::{state} AS a FROM (SELECT DISTINCT conv_id FROM conversations)"
    return f"""
        WITH RECURSIVE coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
        judged AS (
            SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair FROM placed),
        marked AS (
            SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
        ready AS (SELECT *, NOT blank AND NOT duplicate AS edit, CASE WHEN truncated THEN 5 ELSE 0 END AS more FROM marked),
        parsed AS (
            {then(first)}
            UNION ALL
            {then(f"SELECT conv_id, pos, {rows} FROM (SELECT p.conv_id, r.pos, n, s, u, a, r.role, r.text, r.edit, r.more FROM parsed p JOIN ready r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1)")}),
        ends AS (
            SELECT conv_id, {best("n", "a")} AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM parsed) WHERE back = 1),
        counted AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, e.e.c AS cost, e.e.a AS audit, sha256(substr(e.e.o, 2)) AS repaired_sha256
        FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


@query("op12_conversation_repair", _repair_sql())
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation after the damage of the contract, repaired at the least cost."""
    return conversations.repair(conversations.damage(table(spark, sf, "conversations")), F.col("lost"))


@query("op13_near_vectors")
def op13_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Links of cosine 0.9 or more among all vectors, counted by row, with their components."""
    return neardup.near_duplicates(table(spark, sf, "embeddings")).rows
