"""Queries of the clause and document library: filters, tiered joins, headings, types, parties; each beside its DuckDB statement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake.functions import arrays as A
from clauselake.functions import dates as D
from clauselake.functions import library as L
from clauselake.functions import numbers as N
from clauselake.functions import providers
from clauselake.functions import text as X
from clauselake.functions.keys import key
from clauselake.operators import dml, relational, rules
from clauselake.plans.core_queries import _LC, _UNITS, _UPLOADS, _latest_clauses, _latest_units, _latest_uploads
from clauselake.session import broadcast_if_small, scratch_folder, table
from clauselake.sources import files
from clauselake.sources.cache import ReadCache
from clauselake.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_FAMILY = [("regulation", ["Regulation", "Guidance"]), ("report", ["Incident Report", "Complaint", "Transcript"])]


def _family(c):
    for name, kinds in reversed(_FAMILY):
        out = F.when(c.isin(kinds), name).otherwise(out if name != _FAMILY[-1][0] else F.when(c.contains("Manual"), "manual").otherwise("contract"))
    return out


_FAMILY_SQL = "CASE WHEN document_type IN ('Regulation', 'Guidance') THEN 'regulation' WHEN document_type IN ('Incident Report', 'Complaint', 'Transcript') THEN 'report' WHEN contains(document_type, 'Manual') THEN 'manual' ELSE 'contract' END"


# --- filters ---


@query(f"SELECT doc_id, {_FAMILY_SQL} AS family, document_type NOT IN ('Regulation', 'Guidance', 'Complaint', 'Transcript') AND (counterparty_name IS NOT NULL OR parent_doc_id IS NOT NULL OR effective_date IS NOT NULL OR expiration_date IS NOT NULL) AS is_contract FROM documents")
def filter_family(spark, d):
    """Family by set membership, then by substring, else the default; contracts are of no other family and have a sign of a relation."""
    signals = [F.col(c).isNotNull() for c in ("counterparty_name", "parent_doc_id", "effective_date", "expiration_date")]
    contract = ~F.col("document_type").isin("Regulation", "Guidance", "Complaint", "Transcript") & (signals[0] | signals[1] | signals[2] | signals[3])
    return table(spark, d, "documents").select("doc_id", _family(F.col("document_type")).alias("family"), contract.alias("is_contract"))


@query("SELECT document_id, coalesce(title, 'Untitled') AS title, coalesce(counterparty_name, entity_name, 'Unknown') AS party, coalesce(governing_state, 'none') AS law, upper(substring(status, 1, 1)) || lower(substring(status, 2)) AS status, coalesce(n_chars, 0) AS n_chars, coalesce(effective_date::VARCHAR, '') AS effective_date FROM documents")
def scan_reshaped(spark, d):
    """Rows in the shape of the contract list, every field with a default."""
    c = lambda x, v: F.coalesce(F.col(x), F.lit(v)).alias(x)
    status = F.concat(F.upper(F.substring("status", 1, 1)), F.lower(F.expr("substring(status, 2)"))).alias("status")
    return table(spark, d, "documents").select("document_id", c("title", "Untitled"), F.coalesce("counterparty_name", "entity_name", F.lit("Unknown")).alias("party"), F.coalesce("governing_state", F.lit("none")).alias("law"), status, c("n_chars", 0), F.coalesce(F.col("effective_date").cast("string"), F.lit("")).alias("effective_date"))


@query(f"""SELECT clause_id FROM {_LC} c JOIN (SELECT lower(trim(document_id, ' \t')) AS k, {_FAMILY_SQL} AS family FROM documents) d ON lower(trim(c.document_id, ' \t')) = d.k
WHERE family = 'contract' AND clause_type IN ('Insurance', 'Audit rights', 'Privacy') AND (contains(lower(entity_name), 'group') OR contains(lower(clause_no), 'group')) AND ((contains(lower(clause_text), 'insurance') AND contains(lower(clause_text), 'shall')) OR contains(lower(clause_text), 'audit'))""")
def filter_library(spark, d):
    """The clause library's filter: family of the document, types, a substring in some column and a boolean text query."""
    docs = table(spark, d, "documents").select(key(F.col("document_id")).alias("k"), _family(F.col("document_type")).alias("family"))
    rows = _latest_clauses(spark, d).join(docs, key(F.col("document_id")) == F.col("k"))
    wanted = L.composite({"family": "contract", "review_status": None}, {"clause_type": ["Insurance", "Audit rights", "Privacy"], "source_page": []}, (["entity_name", "clause_no"], "Group"), ("clause_text", "insurance shall OR audit"))
    return rows.where(wanted).select("clause_id")


@query("""SELECT doc_id FROM documents WHERE (contains(lower(title), 'ins') OR contains(lower(coalesce(counterparty_name, '')), 'ins') OR contains(lower(coalesce(entity_name, '')), 'ins') OR contains(lower(document_type), 'ins') OR contains(lower(coalesce(governing_state, '')), 'ins'))
AND ((lower(status) IN ('active', 'draft') AND governing_state IN ('AZ', 'MO', 'NY', 'CA')) OR document_type IN ('Regulation', 'Guidance'))""")
def filter_contracts(spark, d):
    """The contract table's filter: a substring over five columns; status and law, which rows that are no contracts pass."""
    docs = table(spark, d, "documents").withColumn("st", F.lower("status"))
    cols = ["title", "counterparty_name", "entity_name", "document_type", "governing_state"]
    return docs.where(L.composite(None, {"st": ["active", "draft"], "governing_state": ["AZ", "MO", "NY", "CA"]}, (cols, " INS"), bypass=F.col("document_type").isin("Regulation", "Guidance"))).select("doc_id")


_WANTED, _UNWANTED = [r"\bshall\b", r"\bmust\b", r"\bagrees? to\b", r"\bis required to\b"], [r"\bmeans\b", r"^see exhibit", r"\brepresents that\b"]


@query("SELECT clause_unit_id, created_at, regexp_matches(unit_text, '(?i)\\bshall\\b|\\bmust\\b|\\bagrees? to\\b|\\bis required to\\b') AND NOT regexp_matches(unit_text, '(?i)\\bmeans\\b|^see exhibit|\\brepresents that\\b') AS is_candidate FROM clause_units")
def filter_candidates(spark, d):
    return table(spark, d, "clause_units").select("clause_unit_id", "created_at", L.candidate(F.col("unit_text"), _WANTED, _UNWANTED).alias("is_candidate"))


@query(f"SELECT clause_id, CASE WHEN survives_termination OR lower(d.status) = 'active' THEN 'active' ELSE 'expired' END AS clause_state FROM {_LC} c LEFT JOIN documents d ON lower(trim(c.document_id, ' \t')) = lower(trim(d.document_id, ' \t'))")
def filter_clause_state(spark, d):
    """A clause is expired unless its document is active or it survives the end."""
    docs = table(spark, d, "documents").select(key(F.col("document_id")).alias("k"), F.lower("status").alias("st"))
    c = _latest_clauses(spark, d).join(docs, key(F.col("document_id")) == F.col("k"), "left")
    return c.select("clause_id", F.when(F.col("survives_termination") | F.coalesce(F.col("st") == "active", F.lit(False)), "active").otherwise("expired").alias("clause_state"))


@query(f"""SELECT clause_unit_id, CASE WHEN list_contains(e, 'obligation') OR len(e) = 0 THEN NULL WHEN len(e) = 1 THEN CASE e[1] WHEN 'permission' THEN 'Derived permission' WHEN 'prohibition' THEN 'Derived prohibition' ELSE 'Creates requirement' END ELSE 'Creates requirement' END AS badge
FROM (SELECT clause_unit_id, list_filter(structural_labels, lambda x: x IN ('obligation', 'permission', 'prohibition', 'condition')) AS e FROM {_UNITS})""")
def filter_badges(spark, d):
    """Labels within a vocabulary, and the mark that they earn."""
    e = A.within(F.col("structural_labels"), ["obligation", "permission", "prohibition", "condition"])
    known = {"permission": "Derived permission", "prohibition": "Derived prohibition"}
    return _latest_units(spark, d).select("clause_unit_id", L.badge(e, F.array_contains(e, "obligation"), known, "Creates requirement").alias("badge"))


@query("SELECT entity_id, name FROM entities WHERE (contains(lower(name), 'data') OR contains(lower(entity_id), 'data')) AND entity_id NOT IN (SELECT entity_id FROM documents WHERE lower(status) = 'deleted')")
def filter_options(spark, d):
    """Options that hold the typed text and are not chosen yet."""
    chosen = table(spark, d, "documents").where(F.lower("status") == "deleted").select("entity_id")
    e = table(spark, d, "entities")
    return e.where(L.any_contains([F.col("name"), F.col("entity_id")], "Data")).join(chosen, "entity_id", "left_anti").select("entity_id", "name")


@query("""SELECT upload_id, regexp_matches(file_name, '(?i)\\.(pdf|docx|doc|txt)$') AS name_ok, CASE WHEN n = 0 THEN 'empty' WHEN ext NOT IN ('pdf', 'docx', 'doc', 'txt') THEN 'bad_type' WHEN ext = 'txt' THEN NULL WHEN file_type IS NOT NULL AND NOT contains(file_type, ext) THEN 'bad_mime' WHEN ext = 'pdf' THEN NULL ELSE 'bad_content' END AS upload_error, CASE WHEN ext = 'txt' THEN t END AS decoded
FROM (SELECT upload_id, file_name, file_type, coalesce(file_text, '') AS t, strlen(coalesce(file_text, '')) AS n, lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) AS ext FROM """ + _UPLOADS + ")")
def scan_uploads(spark, d):
    """Uploads checked as files: name, size, kind, declared type and first bytes (here: a PDF head before the text of PDFs only), and text files decoded."""
    u = _latest_uploads(spark, d)
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    body = F.encode(F.coalesce("file_text", F.lit("")), "UTF-8")
    u = u.select("upload_id", "file_name", F.col("file_type").alias("mime"), ext.alias("extension"), F.length(body).alias("length"), F.when(ext == "pdf", F.concat(F.encode(F.lit("%PDF-1.7"), "UTF-8"), body)).otherwise(body).alias("content"))
    c = files.checked(u, mime="mime")
    return c.select("upload_id", L.acceptable_file(F.col("file_name")).alias("name_ok"), "upload_error", F.when(F.col("extension") == "txt", F.decode("content", "UTF-8")).alias("decoded"))


# --- changes ---


@query("""WITH keep AS (SELECT * FROM canonical_obligation_sources WHERE document_id NOT IN (SELECT document_id FROM documents WHERE lower(status) = 'superseded') OR document_id IS NULL)
SELECT o.id, o.canonical_obligation_id FROM canonical_obligation_sources o WHERE canonical_obligation_id NOT IN (SELECT canonical_obligation_id FROM keep)""")
def change_cascade(spark, d):
    """Sources of superseded documents are taken away; obligations left without any source go, and what hangs on them (here: the rows that are to be removed)."""
    s = table(spark, d, "canonical_obligation_sources")
    gone = table(spark, d, "documents").where(F.lower("status") == "superseded").select("document_id")
    kept = s.join(gone, "document_id", "left_anti")
    return s.join(kept.select("canonical_obligation_id"), "canonical_obligation_id", "left_anti").select("id", "canonical_obligation_id")


@query(f"SELECT upload_id, n_rows, last_status FROM (SELECT upload_id, count(*) AS n_rows, max_by(extraction_status, (created_at, extraction_status)) AS last_status FROM (SELECT upload_id, extraction_status, created_at FROM document_uploads UNION ALL SELECT upload_id, 'audited', created_at + INTERVAL 1 DAY FROM {_UPLOADS} WHERE extraction_status = 'failed') GROUP BY 1)")
def change_append(spark, d):
    """Audit rows are appended, never changed; the latest row of a key is its state."""
    u = table(spark, d, "document_uploads").select("upload_id", "extraction_status", "created_at")
    audit = _latest_uploads(spark, d).where("extraction_status = 'failed'").select("upload_id", F.lit("audited").alias("extraction_status"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return u.unionAll(audit).groupBy("upload_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("extraction_status", F.struct("created_at", "extraction_status")).alias("last_status"))


@query("SELECT entity_id, name, NULL::INTEGER AS rank, TRY_CAST(state AS INTEGER) AS state FROM entities")
def change_conform(spark, d):
    """Rows made to fit a table: unknown columns dropped, missing ones null, values of another type null."""
    schema = T._parse_datatype_string("entity_id string, name string, rank int, state int")
    return dml.conform(table(spark, d, "entities"), schema)


@query("SELECT entity_id, to_json({'video': state, 'audio': state, 'kind': entity_subtype})::VARCHAR AS consent FROM entities WHERE state IS NOT NULL")
def value_struct(spark, d):
    """A single value spread over the fields of a struct."""
    e = table(spark, d, "entities").where("state IS NOT NULL")
    return e.select("entity_id", F.to_json(F.struct(F.col("state").alias("video"), F.col("state").alias("audio"), F.col("entity_subtype").alias("kind"))).alias("consent"))


@query("SELECT clause_id, to_json({'subject': lower(entity_name), 'action': clause_type, 'condition': clause_no})::VARCHAR AS terms, CASE WHEN clause_type IS NULL AND clause_no IS NULL THEN NULL ELSE concat_ws(' — ', clause_type, nullif(trim(clause_no), '')) END AS summary FROM " + _LC)
def value_terms(spark, d):
    """Terms of a requirement as one struct, and its summary."""
    terms = F.to_json(F.struct(F.lower("entity_name").alias("subject"), F.col("clause_type").alias("action"), F.col("clause_no").alias("condition")), {"ignoreNullFields": "false"})
    return _latest_clauses(spark, d).select("clause_id", terms.alias("terms"), L.joined_summary(F.col("clause_type"), F.col("clause_no")).alias("summary"))


@query("WITH m AS (SELECT lower(citation) AS k, min(id) AS id FROM regulatory_sources GROUP BY 1) SELECT r.id, m.id AS first_id FROM regulatory_sources r JOIN m ON lower(r.citation) = m.k")
def value_key_map(spark, d):
    """Key to id: the first id of each key, joined back."""
    r = table(spark, d, "regulatory_sources").select("id", F.lower("citation").alias("k"))
    return r.join(r.groupBy("k").agg(F.min("id").alias("first_id")), "k").select("id", "first_id")


@query("SELECT entity_id, coalesce(array_to_string(aliases, '|'), '') || '#' || replace(name, ', ', '|') AS both_ways FROM entities")
def value_coerced(spark, d):
    """Values that come as a JSON array or as a delimited string, as arrays."""
    e = table(spark, d, "entities").select("entity_id", L.as_values(F.to_json("aliases")).alias("a"), L.as_values(F.col("name")).alias("b"))
    return e.select("entity_id", F.concat(F.array_join("a", "|"), F.lit("#"), F.array_join("b", "|")).alias("both_ways"))


# --- joins ---


@query(f"""SELECT c.clause_id, coalesce(o.n, 0) AS n_sources, coalesce(o.roles, '') AS roles, coalesce(o.controlling, false) AS controlling FROM {_LC} c LEFT JOIN (
SELECT k, sum(n)::BIGINT AS n, string_agg(provenance_role, ',' ORDER BY first_at, provenance_role) AS roles, bool_or(controlling) AS controlling FROM (
  SELECT lower(trim(clause_id, ' \t')) AS k, provenance_role, min(created_at) AS first_at, count(*) AS n, bool_or(resolution_role = 'controlling') AS controlling FROM canonical_obligation_sources WHERE clause_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) o ON lower(trim(c.clause_id, ' \t')) = o.k""")
def join_summaries(spark, d):
    """Clauses with a summary of their obligation sources: count, roles in the order they first came, flags."""
    s = table(spark, d, "canonical_obligation_sources").where("clause_id IS NOT NULL").withColumn("k", key(F.col("clause_id"))).where("k IS NOT NULL")
    by_role = s.groupBy("k", "provenance_role").agg(F.min("created_at").alias("at"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("resolution_role") == "controlling").alias("c"))
    o = by_role.groupBy("k").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "provenance_role"))), lambda x: x["provenance_role"]), ",").alias("roles"), F.bool_or("c").alias("c"))  # at most a row a role
    c = _latest_clauses(spark, d).select("clause_id").join(o, key(F.col("clause_id")) == F.col("k"), "left")
    return c.select("clause_id", F.coalesce("n", F.lit(0)).alias("n_sources"), F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("c", F.lit(False)).alias("controlling"))


@query("""SELECT canonical_obligation_id, s.id, r.title, r.jurisdiction_level FROM (SELECT * FROM canonical_obligation_sources
QUALIFY row_number() OVER (PARTITION BY canonical_obligation_id ORDER BY (clause_id IS NULL)::INT, (resolution_role <> 'controlling')::INT, created_at, id) = 1) s LEFT JOIN regulatory_sources r ON s.regulatory_source_id = r.id""")
def join_star(spark, d):
    """Obligation, its preferred source, and the topic that the source names."""
    s = relational.latest(table(spark, d, "canonical_obligation_sources"), ["canonical_obligation_id"], [F.col("clause_id").isNull().cast("int"), (F.col("resolution_role") != "controlling").cast("int"), "created_at", "id"])
    r = table(spark, d, "regulatory_sources").select(F.col("id").alias("rid"), "title", "jurisdiction_level")
    return s.join(r, F.col("regulatory_source_id") == F.col("rid"), "left").select("canonical_obligation_id", "id", "title", "jurisdiction_level")


@query("SELECT c.clause_id, c.created_at, u.extraction_status FROM clauses c JOIN (SELECT DISTINCT document_id, extraction_status FROM document_uploads WHERE extraction_status <> 'done') u ON c.document_id = u.document_id")
def join_impact(spark, d):
    """Clauses that an event touches, with the event's attribute carried over."""
    u = table(spark, d, "document_uploads").where("extraction_status <> 'done'").select("document_id", "extraction_status").distinct()
    return table(spark, d, "clauses").join(u, "document_id").select("clause_id", "created_at", "extraction_status")


@query("SELECT entity_id, document_id FROM (SELECT e.parent_entity_id AS entity_id, d.document_id FROM documents d JOIN entities e ON d.entity_id = e.entity_id WHERE e.entity_subtype = 'vendor' AND e.parent_entity_id IS NOT NULL UNION SELECT e.entity_id, d.document_id FROM documents d JOIN entities e ON d.counterparty_name = e.name WHERE e.entity_subtype = 'vendor')")
def join_providers(spark, d):
    """Links of vendors by either way, once each."""
    docs, e = table(spark, d, "documents"), table(spark, d, "entities").where("entity_subtype = 'vendor'")
    up = docs.join(e.where("parent_entity_id IS NOT NULL").select("entity_id", "parent_entity_id"), "entity_id").select(F.col("parent_entity_id").alias("entity_id"), "document_id")
    other = docs.select("document_id", "counterparty_name").join(e.select("entity_id", "name"), F.col("counterparty_name") == F.col("name")).select("entity_id", "document_id")
    return up.unionByName(other).distinct()


_KN = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT entity_id, ' ' || {_KN.format(c='alias')} || ' ' AS k FROM (SELECT entity_id, unnest(aliases) AS alias FROM entities) WHERE alias <> ''),
d AS (SELECT doc_id, ' ' || {_KN.format(c='counterparty_name')} || ' ' AS p FROM documents WHERE counterparty_name IS NOT NULL)
SELECT d.doc_id, min(entity_id) AS entity_id, CASE WHEN min(entity_id) IS NULL THEN 'counterparty' ELSE 'known' END AS party_kind FROM d LEFT JOIN k ON contains(d.p, k.k) GROUP BY 1""")
def join_known_parties(spark, d):
    """Parties whose name holds a known name as words, the first of several; the others are counterparties. Names meet by a shared word, so the join is a hash join."""
    known = table(spark, d, "entities").select("entity_id", F.explode("aliases").alias("alias")).select("entity_id", L.type_key(F.col("alias")).alias("n")).where("n <> ''").withColumn("w", X.first_word(F.col("n")))
    docs = table(spark, d, "documents").where("counterparty_name IS NOT NULL").select("doc_id", L.type_key(F.col("counterparty_name")).alias("p"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hit = docs.withColumn("w", F.explode(F.array_distinct(F.split("p", " ")))).join(broadcast_if_small(known, known.count()), "w").where(F.contains(pad("p"), pad("n"))).groupBy("doc_id").agg(F.min("entity_id").alias("entity_id"))
    return docs.join(hit, "doc_id", "left").select("doc_id", "entity_id", F.when(F.col("entity_id").isNull(), "counterparty").otherwise("known").alias("party_kind"))


# Rules of a playbook and words that mean the same.
RULES = [("Insurance", 1), ("Audit", 2), ("Confidentiality", 3), ("Termination", 4), ("Data retention", 5)]
SYNONYMS = {"privacy": "Data retention", "payment terms": "Audit", "indemnity": "Insurance"}
_RULE_ROWS = ", ".join(f"('{n}', {i})" for n, i in RULES)
_SYN_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS.items())


@query(f"""SELECT clause_id, rule_name, match_tier FROM (SELECT c.clause_id, r.rule_name, r.ord, CASE WHEN lower(clause_type) = lower(rule_name) THEN 1 WHEN contains(lower(clause_type), lower(rule_name)) OR contains(lower(rule_name), lower(clause_type)) THEN 2 WHEN s.b = rule_name THEN 3 END AS match_tier
FROM {_LC} c CROSS JOIN (VALUES {_RULE_ROWS}) r(rule_name, ord) LEFT JOIN (VALUES {_SYN_ROWS}) s(a, b) ON lower(clause_type) = s.a) WHERE match_tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY match_tier, ord) = 1""")
def join_rules(spark, d):
    """The rule of a clause: same name, one name in the other, a synonym; the first of a tier. A handful of rules, so an expression and no join."""
    t = F.lower("clause_type")
    syn = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    tier = lambda r: F.when(t == r.lower(), 1).when(t.contains(r.lower()) | F.contains(F.lit(r.lower()), t), 2).when(F.try_element_at(syn, t) == r, 3)
    best = F.array_min(F.array_compact(F.array(*[F.when(tier(r).isNotNull(), F.struct(tier(r).alias("tier"), F.lit(i).alias("ord"), F.lit(r).alias("name"))) for r, i in RULES])))
    return _latest_clauses(spark, d).select("clause_id", best.alias("b")).where("b IS NOT NULL").select("clause_id", F.col("b.name").alias("rule_name"), F.col("b.tier").alias("match_tier"))


@query(f"""SELECT a.clause_id, string_agg(b.clause_id, ',' ORDER BY b.clause_id) AS related FROM {_LC} a JOIN (SELECT document_id, clause_type, clause_id, row_number() OVER (PARTITION BY document_id, clause_type ORDER BY clause_id) AS rn FROM {_LC} WHERE document_id IS NOT NULL AND clause_type IS NOT NULL) b
ON a.document_id = b.document_id AND a.clause_type = b.clause_type AND a.clause_id <> b.clause_id
WHERE b.rn <= CASE WHEN (SELECT count(*) FROM (SELECT * FROM {_LC}) z WHERE z.document_id = a.document_id AND z.clause_type = a.clause_type AND z.clause_id < a.clause_id) < 3 THEN 4 ELSE 3 END GROUP BY 1""")
def window_related(spark, d):
    """The first three other clauses of the same document and type. Only four candidates a group travel, so a hot group stays small."""
    c = _latest_clauses(spark, d).where("document_id IS NOT NULL AND clause_type IS NOT NULL").select("document_id", "clause_type", "clause_id")
    four = relational.first_n(c, ["document_id", "clause_type"], [F.asc("clause_id")], 4).groupBy("document_id", "clause_type").agg(F.sort_array(F.collect_list("clause_id")).alias("ids"))
    near = F.slice(F.filter("ids", lambda x: x != F.col("clause_id")), 1, 3)
    return c.join(four, ["document_id", "clause_type"]).select("clause_id", F.array_join(near, ",").alias("related")).where("related <> ''")


@query("""SELECT a.id, min(b.id) AS matched_id FROM canonical_obligation_sources a JOIN canonical_obligation_sources b ON a.regulatory_source_id = b.regulatory_source_id AND a.resolution_role = b.resolution_role WHERE a.provenance_role = 'originating' AND b.provenance_role = 'supporting' GROUP BY 1""")
def join_first_facet(spark, d):
    """Each originating row with the first supporting row of its topic and facet. The first is found before the join: one row a facet, whatever the topic's size."""
    s = table(spark, d, "canonical_obligation_sources").where("regulatory_source_id IS NOT NULL")
    first = s.where("provenance_role = 'supporting'").groupBy("regulatory_source_id", "resolution_role").agg(F.min("id").alias("matched_id"))
    return s.where("provenance_role = 'originating'").select("id", "regulatory_source_id", "resolution_role").distinct().join(first, ["regulatory_source_id", "resolution_role"]).select("id", "matched_id")


@query(f"""SELECT clause_unit_id, clause_id, match_tier FROM (SELECT u.clause_unit_id, c.clause_id, CASE WHEN c.clause_no IS NOT NULL AND contains(u.unit_text, ' ' || c.clause_no) THEN 1 WHEN length(u.unit_text) > 15 AND contains(c.clause_text, substring(u.unit_text, 1, 60)) THEN 2 END AS match_tier
FROM {_UNITS} u JOIN {_LC} c ON u.document_id = c.document_id) WHERE match_tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clause_unit_id ORDER BY match_tier, clause_id) = 1""")
def join_quotes(spark, d):
    """The clause that a passage belongs to, within its document: its number is named, else its beginning is quoted."""
    u = _latest_units(spark, d).select("clause_unit_id", F.col("document_id").alias("du"), "unit_text")
    c = _latest_clauses(spark, d).select("clause_id", F.col("document_id").alias("dc"), "clause_no", "clause_text")
    tiers = [F.contains("unit_text", F.concat(F.lit(" "), F.col("clause_no"))), (F.length("unit_text") > 15) & F.contains("clause_text", F.substring("unit_text", 1, 60))]
    return relational.best_match(u, c, "clause_unit_id", tiers, ["clause_id"], [("du", "dc")]).select("clause_unit_id", "clause_id", "match_tier")


@query("SELECT d.doc_id, CASE WHEN regexp_matches(d.entity_id, '^ent_[0-9]+$') THEN coalesce(e.name, d.entity_name, d.counterparty_name, 'Unknown') ELSE coalesce(d.entity_id, d.entity_name, 'Unknown') END AS party FROM documents d LEFT JOIN entities e ON d.entity_id = e.entity_id")
def join_display(spark, d):
    """A party's display name: what looks like an id is looked up, with fallbacks in order."""
    e = table(spark, d, "entities").select("entity_id", "name")
    docs = table(spark, d, "documents").select("doc_id", "entity_id", "entity_name", "counterparty_name").join(e, "entity_id", "left")
    return docs.select("doc_id", F.when(F.col("entity_id").rlike("^ent_[0-9]+$"), F.coalesce("name", "entity_name", "counterparty_name", F.lit("Unknown"))).otherwise(F.coalesce("entity_id", "entity_name", F.lit("Unknown"))).alias("party"))


@query(f"SELECT u.upload_id, u.extraction_status, d.title, d.document_type FROM {_UPLOADS} u LEFT JOIN documents d ON lower(trim(u.document_id, ' \t')) = lower(trim(d.document_id, ' \t'))")
def join_jobs(spark, d):
    docs = table(spark, d, "documents").select(key(F.col("document_id")).alias("k"), "title", "document_type")
    return _latest_uploads(spark, d).join(docs, key(F.col("document_id")) == F.col("k"), "left").select("upload_id", "extraction_status", "title", "document_type")


# --- aggregates ---

_BANDS = [(8.0, "critical"), (6.0, "high"), (3.0, "moderate")]


@query("SELECT user_id, s AS score, CASE WHEN s >= 8 THEN 'critical' WHEN s >= 6 THEN 'high' WHEN s >= 3 THEN 'moderate' ELSE 'low' END AS band FROM (SELECT user_id, floor(least(10, greatest(0, sum(CASE event_type WHEN 'error' THEN 0.75 WHEN 'purchase' THEN -0.25 ELSE 0.05 END))) * 100 + 0.5 + 1e-6) / 100 AS s FROM events GROUP BY 1)")
def agg_scores(spark, d):
    """Sum of factor weights, kept between 0 and 10, two digits, and its band."""
    w = F.when(F.col("event_type") == "error", 0.75).when(F.col("event_type") == "purchase", -0.25).otherwise(0.05)
    s = N.half_up(N.clamp(F.sum(w), 0.0, 10.0) + 1e-8, 2)
    return table(spark, d, "events").groupBy("user_id").agg(s.alias("score")).withColumn("band", L.band(F.col("score"), _BANDS, "low"))


@query("""WITH s AS (SELECT source, count(*) AS n, count_if(lower(status) = 'active') AS active, count(DISTINCT entity_id) AS n_entities FROM documents GROUP BY 1)
SELECT source, n, active, n_entities, CASE WHEN n >= 150 THEN 'large' WHEN n >= 60 THEN 'medium' ELSE 'small' END AS size_band, rank() OVER (ORDER BY active DESC, source)::INTEGER AS place FROM s""")
def agg_portfolio(spark, d):
    """Counts, distinct owners and bands of each source, and the sources in order: pre-aggregated before the only ranking."""
    s = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("status") == "active").alias("active"), F.countDistinct("entity_id").alias("n_entities"))
    order = F.row_number().over(relational.W.orderBy(F.desc("active"), "source"))  # a row a source
    return s.select("source", "n", "active", "n_entities", L.band(F.col("n"), [(150, "large"), (60, "medium")], "small").alias("size_band"), order.alias("place"))


@query("SELECT (SELECT count(*) FROM document_uploads WHERE extraction_status = 'queued') AS open_jobs, (SELECT count(*) FROM document_uploads WHERE extraction_status = 'failed') AS failed_jobs, (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM documents WHERE expiration_date < DATE '2026-01-01' AND lower(status) = 'active') AS overdue")
def agg_workspace(spark, d):
    """Key figures of several tables in one row: each table is one aggregate of one row."""
    u = table(spark, d, "document_uploads").agg(F.count_if(F.col("extraction_status") == "queued").alias("open_jobs"), F.count_if(F.col("extraction_status") == "failed").alias("failed_jobs"))
    e = table(spark, d, "entities").agg(F.count(F.lit(1)).alias("n_entities"))
    o = table(spark, d, "documents").agg(F.count_if((F.col("expiration_date") < F.lit("2026-01-01").cast("date")) & (F.lower("status") == "active")).alias("overdue"))
    return u.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(o))  # one row each


@query(f"SELECT document_id, count(*) AS n_clauses, count(DISTINCT clause_type) AS n_types FROM {_LC} WHERE document_id IS NOT NULL GROUP BY 1")
def agg_clause_counts(spark, d):
    return _latest_clauses(spark, d).where("document_id IS NOT NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.countDistinct("clause_type").alias("n_types"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def agg_history(spark, d):
    """Distinct values of a history."""
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


# --- order ---


@query(f"SELECT document_id, clause_id FROM {_LC} WHERE document_id IS NOT NULL AND clause_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, {_KN.format(c='clause_type')} ORDER BY source_page, clause_id) = 1")
def window_keep_first(spark, d):
    """Of the clauses of one normalised type the first of a document is kept."""
    c = _latest_clauses(spark, d).where("document_id IS NOT NULL AND clause_type IS NOT NULL").withColumn("tk", L.type_key(F.col("clause_type")))
    return relational.latest(c, ["document_id", "tk"], ["source_page", "clause_id"]).select("document_id", "clause_id")


@query(f"SELECT clause_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(ai_confidence, -1) DESC, lower(coalesce(clause_type, '')), clause_id)::INTEGER AS by_score, row_number() OVER (PARTITION BY document_id ORDER BY created_at, clause_id)::INTEGER AS by_time FROM {_LC} WHERE document_id IS NOT NULL")
def order_clauses(spark, d):
    """Places by the user's orders: scores with null as -1, else lower-case text; and by time."""
    c = _latest_clauses(spark, d).where("document_id IS NOT NULL")
    a = c.withColumn("s", F.coalesce("ai_confidence", F.lit(-1.0))).withColumn("t", F.lower(F.coalesce("clause_type", F.lit(""))))
    a = relational.numbered(a.select("document_id", "clause_id", "created_at", "s", "t"), ["document_id"], [F.desc("s"), F.asc("t"), F.asc("clause_id")], "by_score")
    return relational.numbered(a, ["document_id"], [F.asc("created_at"), F.asc("clause_id")], "by_time").select("clause_id", "by_score", "by_time")


@query("""SELECT canonical_obligation_id, string_agg(id, ',' ORDER BY (provenance_role <> 'originating')::INT, lower(resolution_role), id) AS in_order FROM canonical_obligation_sources GROUP BY 1""")
def order_sources(spark, d):
    """Originating sources before derived ones, then by text."""
    o = F.sort_array(F.collect_list(F.struct((F.col("provenance_role") != "originating").cast("int"), F.lower("resolution_role"), "id")))
    return table(spark, d, "canonical_obligation_sources").groupBy("canonical_obligation_id").agg(F.array_join(F.transform(o, lambda x: x["id"]), ",").alias("in_order"))


@query(f"SELECT clause_id, coalesce(nullif(regexp_extract(clause_no, '^\\s*([0-9]+([.][0-9]+)*)', 1), ''), nullif(regexp_extract(clause_id, '0*([0-9]+)$', 1), '')) AS display_no FROM {_LC}")
def order_display_no(spark, d):
    return _latest_clauses(spark, d).select("clause_id", L.display_number(F.col("clause_no"), F.col("clause_id")).alias("display_no"))


@query("SELECT doc_id, array_to_string(list_concat(list_filter(u, lambda x: len(string_split(x, ' ')) <= 2), list_filter(u, lambda x: len(string_split(x, ' ')) > 2)), '|') AS parties FROM (SELECT doc_id, list_filter([entity_name, CASE WHEN lower(counterparty_name) = lower(entity_name) THEN NULL ELSE counterparty_name END, upper(document_type)], lambda x: trim(x) <> '') AS u FROM documents)")
def set_parties(spark, d):
    """Party lists united without case, first spelling kept; short role labels stand before names, else the order stays."""
    u = L.unite(F.array_compact(F.array("entity_name", "counterparty_name")), F.array_compact(F.array(F.upper("entity_name"), F.upper("document_type"))))
    short = lambda x: F.size(F.split(x, " ")) <= 2
    docs = table(spark, d, "documents").select("doc_id", u.alias("u"))
    return docs.select("doc_id", F.array_join(F.concat(F.filter("u", short), F.filter("u", lambda x: ~short(x))), "|").alias("parties"))


# --- text ---


@query("""SELECT document_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(file_text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: NOT regexp_full_match(x, '[ \\t\\r]*(\\d{1,3}|[Pp]age\\s+\\d+(\\s+of\\s+\\d+)?|\\d{1,3}\\s+of\\s+\\d{1,3}|-\\s*\\d{1,3}\\s*-|[\\[(]\\d{1,3}[\\])]|\\d{1,3}\\s*\\|\\s*[Pp]age|[Pp]age\\s*\\|\\s*\\d{1,3})[ \\t\\r]*')), chr(10)),
'[ \\t]*[\\[(]?\\b[Pp]age \\d{1,4} of \\d{1,4}\\b[\\])]?', '', 'g'), '(\\p{Ll})-\\n(\\p{Ll})', '\\1\\2', 'g'), '[ \\t\\x{A0}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' ) AS clean_text FROM documents WHERE file_text IS NOT NULL""")
def text_cleaned(spark, d):
    return table(spark, d, "documents").where("file_text IS NOT NULL").select("document_id", L.cleaned(F.col("file_text")).alias("clean_text"))


# Key words of headings, and of the first words of a text, with the types they stand for.
HEADING_TYPES = [("insur", "Insurance"), ("audit", "Audit rights"), ("payment", "Payment terms"), ("confiden", "Confidentiality"), ("terminat", "Term and termination"), ("notice", "Notices"), ("record", "Recording consent"), ("defin", "Definitions"), ("privacy", "Privacy"), ("retention", "Data retention")]
CONTENT_RULES = [("Insurance", r"\binsur", 1), ("Audit rights", r"\baudit", 1), ("Payment terms", r"\$[0-9]|\bpay\b|\binvoice", 2), ("Confidentiality", r"\bconfidential|\bdisclos|\bsecret", 2), ("Definitions", r"\bmeans\b", 1)]
_HT_SQL = " ".join(f"WHEN contains(lower(title), '{w}') THEN '{k}'" for w, k in HEADING_TYPES)
_CT_SQL = " ".join(f"WHEN len(regexp_extract_all(substring(clause_text, 1, 200), '(?i){p}')) >= {n} THEN '{k}'" for k, p, n in CONTENT_RULES)


@query(f"SELECT doc_id, CASE WHEN length(title) <= 80 THEN CASE {_HT_SQL} END END AS heading_type FROM documents")
def text_heading_types(spark, d):
    return table(spark, d, "documents").select("doc_id", L.typed_heading(F.col("title"), HEADING_TYPES).alias("heading_type"))


@query(f"SELECT clause_id, created_at, CASE {_CT_SQL} ELSE 'Other' END AS content_type FROM clauses")
def text_content_types(spark, d):
    return table(spark, d, "clauses").select("clause_id", "created_at", L.typed_content(F.col("clause_text"), CONTENT_RULES, 200, "Other").alias("content_type"))


@query("SELECT clause_id, created_at, CASE WHEN coalesce(clause_no, '') <> '' THEN trim(clause_no) END AS number, clause_type AS title, clause_text AS body FROM clauses WHERE clause_type IS NOT NULL AND (clause_no IS NULL OR regexp_full_match(clause_no, '\\d+(\\.\\d+)*')) AND regexp_matches(clause_text, '^\\S')")
def text_headings(spark, d):
    """Number, title and body told apart again, after they were put together."""
    c = table(spark, d, "clauses").where(F.col("clause_type").isNotNull() & (F.col("clause_no").isNull() | F.col("clause_no").rlike(r"^\d+(\.\d+)*$")) & F.col("clause_text").rlike(r"^\S"))
    block = F.concat(F.coalesce(F.concat(F.trim("clause_no"), F.lit(". ")), F.lit("")), "clause_type", F.lit(".\n"), "clause_text")
    return c.select("clause_id", "created_at", L.heading(block).alias("h")).select("clause_id", "created_at", "h.number", "h.title", "h.body")


@query("""SELECT clause_id, created_at, len(CASE WHEN len(a) > 1 THEN a WHEN len(b) > 1 THEN b ELSE c END) AS n_parts, (CASE WHEN len(a) > 1 THEN a WHEN len(b) > 1 THEN b ELSE c END)[1] AS first_part FROM (SELECT clause_id, created_at,
list_filter(list_transform(regexp_split_to_array(regexp_replace(clause_text, '\\s+(\\([a-z0-9]{1,3}\\)\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 30) AS a,
list_filter(list_transform(regexp_split_to_array(clause_text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: length(x) >= 30) AS b,
list_filter(list_transform(string_split(regexp_replace(clause_text, '([.;])\\s+(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 30) AS c FROM clauses WHERE clause_text IS NOT NULL)""")
def text_subclauses(spark, d):
    c = table(spark, d, "clauses").where("clause_text IS NOT NULL").select("clause_id", "created_at", L.subclauses(F.col("clause_text")).alias("p"))
    return c.select("clause_id", "created_at", F.size("p").cast("long").alias("n_parts"), F.get("p", F.lit(0)).alias("first_part"))


TYPE_NAMES = ["Insurance", "Audit rights", "Term and termination", "Data retention", "Privacy", "Notices"]
TYPE_ALIASES = {"payment terms": "Other money", "confidentiality": "Privacy", "indemnity": "Insurance"}


@query("""SELECT id, CASE WHEN k IN ('insurance', 'audit rights', 'term and termination', 'data retention', 'privacy', 'notices') THEN CASE k WHEN 'insurance' THEN 'Insurance' WHEN 'audit rights' THEN 'Audit rights' WHEN 'term and termination' THEN 'Term and termination' WHEN 'data retention' THEN 'Data retention' WHEN 'privacy' THEN 'Privacy' ELSE 'Notices' END
WHEN k = 'payment terms' THEN 'Other money' WHEN k = 'confidentiality' THEN 'Privacy' WHEN k = 'indemnity' THEN 'Insurance'
WHEN contains(k, 'insurance') OR contains('insurance', k) THEN 'Insurance' WHEN contains(k, 'audit rights') OR contains('audit rights', k) THEN 'Audit rights' WHEN contains(k, 'term and termination') OR contains('term and termination', k) THEN 'Term and termination'
WHEN contains(k, 'data retention') OR contains('data retention', k) THEN 'Data retention' WHEN contains(k, 'privacy') OR contains('privacy', k) THEN 'Privacy' WHEN contains(k, 'notices') OR contains('notices', k) THEN 'Notices' ELSE 'Other' END AS clause_kind
FROM (SELECT id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM regulatory_sources WHERE length(title) >= 6)""")
def text_types(spark, d):
    """Free text to a vocabulary by tiers: name, alias, part, default."""
    return table(spark, d, "regulatory_sources").where(F.length("title") >= 6).select("id", L.normalized_type(F.col("title"), TYPE_NAMES, TYPE_ALIASES, "Other").alias("clause_kind"))


FORM_RULES = [("duty", r"\b(?:shall|must|will)\b"), ("grant", r"\b(?:may|is entitled to|has the right to)\b"), ("definition", r"\bmeans\b"), ("money", r"\$[0-9]"), ("deadline", r"\b[0-9]+ (?:business |calendar )?(?:days|hours)\b"), ("exception", r"\b(?:unless|except|without regard)\b")]
_FORMS_SQL = ", ".join(f"CASE WHEN regexp_matches(clause_text, '(?i){p}') THEN '{k}' END" for k, p in FORM_RULES)


@query(f"SELECT clause_id, created_at, array_to_string(list_filter([{_FORMS_SQL}], lambda x: x IS NOT NULL), ',') AS forms FROM clauses")
def text_forms(spark, d):
    """All forms of a clause: category words and modifiers."""
    return table(spark, d, "clauses").select("clause_id", "created_at", F.array_join(X.all_matching(F.col("clause_text"), [(k, "(?i)" + p) for k, p in FORM_RULES]), ",").alias("forms"))


@query("""SELECT clause_unit_id, created_at, nullif(regexp_extract(unit_text, '["“]([^"”]{2,60})["”]\\s+(?:means|shall mean)', 1), '') AS defined_term, regexp_matches(unit_text, ':\\s*$') AS opens_list FROM clause_units""")
def text_inline(spark, d):
    """Terms defined in passing, and stems that open a list."""
    t = F.col("unit_text")
    return table(spark, d, "clause_units").select("clause_unit_id", "created_at", F.nullif(F.regexp_extract(t, r"[\"“]([^\"”]{2,60})[\"”]\s+(?:means|shall mean)", 1), F.lit("")).alias("defined_term"), t.rlike(r":\s*$").alias("opens_list"))


@query(f"""SELECT clause_id, array_to_string(f, '; ') AS reason, len(f) > 0 AS needs_review FROM (SELECT clause_id, list_filter([CASE WHEN ai_confidence < 0.5 THEN 'low confidence' END, CASE WHEN clause_type IS NULL THEN 'no type' END, CASE WHEN length(clause_text) < 40 THEN 'short' END, CASE WHEN clause_no IS NULL THEN 'no number' END, CASE WHEN document_id IS NULL THEN 'no document' END, CASE WHEN contains(clause_text, chr(65533)) THEN 'unreadable' END], lambda x: x IS NOT NULL) AS f FROM {_LC})""")
def text_flags(spark, d):
    f = L.flags([("low confidence", F.col("ai_confidence") < 0.5), ("no type", F.col("clause_type").isNull()), ("short", F.length("clause_text") < 40), ("no number", F.col("clause_no").isNull()), ("no document", F.col("document_id").isNull()), ("unreadable", F.contains("clause_text", F.lit("�")))])
    return _latest_clauses(spark, d).select("clause_id", f.alias("f")).select("clause_id", F.coalesce("f.reason", F.lit("")).alias("reason"), "f.needs_review")


DOC_RULES = [("order", r"\border form\b"), ("master", r"\bmaster services agreement\b"), ("change", r"\bamendment\b"), ("statute", r"\bregulation\b")]
_DOC_SQL = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{k}' END" for k, p in DOC_RULES)


@query(f"SELECT doc_id, CASE WHEN len(h) = 1 THEN h[1] END AS doc_kind, CASE WHEN len(h) = 1 THEN 0.82 END AS kind_confidence FROM (SELECT doc_id, list_filter([{_DOC_SQL}], lambda x: x IS NOT NULL) AS h FROM (SELECT doc_id, substring(title || chr(10) || coalesce(text, ''), 1, 1500) AS t FROM documents))")
def text_doc_types(spark, d):
    """The kind that just one structural pattern gives; several or none leave it open."""
    k = L.single_hit(F.concat("title", F.lit("\n"), F.coalesce("text", F.lit(""))), DOC_RULES, 1500)
    return table(spark, d, "documents").select("doc_id", k.alias("doc_kind")).withColumn("kind_confidence", F.when(F.col("doc_kind").isNotNull(), 0.82))


@query("SELECT document_id, CASE WHEN governing_state IN ('AZ', 'MO', 'KY', 'NJ', 'NY') THEN governing_state END AS law FROM documents")
def text_law(spark, d):
    """Governing law read back from a sentence made of the state; only listed places count."""
    t = F.concat(F.lit("This Agreement is governed by and construed under the laws of the State of "), F.coalesce("governing_state", F.lit("nowhere")), F.lit(", without regard to conflicts."))
    return table(spark, d, "documents").select("document_id", L.governing_law(t, ["AZ", "MO", "KY", "NJ", "NY"]).alias("law"))


@query("SELECT document_id, effective_date::VARCHAR AS effective, expiration_date::VARCHAR AS expires FROM documents WHERE effective_date BETWEEN DATE '1970-01-01' AND DATE '2100-12-31'")
def text_dates(spark, d):
    """Dates read back from sentences in two shapes."""
    docs = table(spark, d, "documents").where(F.col("effective_date").between(F.lit("1970-01-01").cast("date"), F.lit("2100-12-31").cast("date")))
    t = F.concat(F.lit("Effective Date: "), F.date_format("effective_date", "MMMM d, yyyy"), F.lit(". "), F.coalesce(F.concat(F.lit("This Agreement expires on "), F.date_format("expiration_date", "M/d/yyyy")), F.lit("No end.")))
    return docs.select("document_id", L.labelled_date(t, ["effective date", "dated"]).cast("string").alias("effective"), L.labelled_date(t, ["expires", "terminates"]).cast("string").alias("expires"))


@query("""SELECT doc_id, 'Vendor=' || regexp_replace(entity_name, '\\.$', '') || '|Client=' || regexp_replace(counterparty_name, '\\.$', '') AS defined, regexp_replace(entity_name, '\\.$', '') AS bare FROM documents WHERE entity_name <> '' AND counterparty_name <> ''""")
def text_defined(spark, d):
    """Parties and their labels from the opening of an agreement (made of the record's names), and a name without its label."""
    docs = table(spark, d, "documents").where("entity_name <> '' AND counterparty_name <> ''")
    a, b = (F.regexp_replace(c, r"\.$", "") for c in ("entity_name", "counterparty_name"))
    t = F.concat(F.lit("between "), a, F.lit(' (the "Vendor") and '), b, F.lit(' (hereinafter the "Client").'))
    terms = F.transform(L.defined_terms(t), lambda x: F.concat(x["label"], F.lit("="), x["name"]))
    return docs.select("doc_id", F.array_join(terms, "|").alias("defined"), L.without_alias(F.concat(a, F.lit(' (the "Vendor")'))).alias("bare"))


@query("""SELECT document_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(file_text, '\\b(?:\\p{Lu}[\\p{L}&''’-]*,?\\s){1,4}(?:Inc|LLC|Ltd|Corp|Group|LLP|PLC|GmbH|Company|Corporation|Limited)\\b\\.?'), lambda x: regexp_replace(x, '^(?:The|This|That|By|Between|And|With|Each|For|At|On)\\s', '')))), '; ') AS parties FROM documents WHERE file_text IS NOT NULL""")
def text_parties(spark, d):
    """Every name in front of a legal form; the forms are a parameter."""
    return table(spark, d, "documents").where("file_text IS NOT NULL").select("document_id", F.array_join(F.sort_array(L.legal_names(F.col("file_text"))), "; ").alias("parties"))


@query("SELECT clause_id, created_at, array_to_string(list_filter(['Insurance', 'audit', 'PAY', 'record'], lambda x: contains(lower(coalesce(clause_text, '')), lower(x))), ',') AS terms FROM clauses")
def text_keywords(spark, d):
    return table(spark, d, "clauses").select("clause_id", "created_at", F.array_join(L.keywords(F.col("clause_text"), ["Insurance", "audit", "PAY", "record"]), ",").alias("terms"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS title_slug, CASE source WHEN 'client_contracts' THEN 'Client Contracts' WHEN 'vendor_contracts' THEN 'Vendor Contracts' END AS source_label FROM documents WHERE source IN ('client_contracts', 'vendor_contracts')")
def text_slugs(spark, d):
    return table(spark, d, "documents").where("source IN ('client_contracts', 'vendor_contracts')").select("doc_id", L.slug(F.col("title")).alias("title_slug"), L.label_of(F.concat(F.lit("source."), "source")).alias("source_label"))


@query(f"SELECT clause_unit_id, effect, n FROM (SELECT clause_unit_id, unnest(e) AS effect, len(e) AS n FROM (SELECT clause_unit_id, list_filter(['prohibition', 'obligation', 'permission'], lambda x: list_contains(structural_labels, x)) AS e FROM {_UNITS}))")
def set_created(spark, d):
    """Rows created from labels: one for each effect of a unit, in the order of their strength."""
    e = F.filter(F.array(*[F.lit(x) for x in ("prohibition", "obligation", "permission")]), lambda x: F.array_contains("structural_labels", x))
    return _latest_units(spark, d).select("clause_unit_id", e.alias("e")).select("clause_unit_id", F.explode("e").alias("effect"), F.size("e").cast("long").alias("n"))


@query(f"""SELECT md5(u.clause_id || '/' || u.clause_unit_id) AS new_id, CASE WHEN p.k IS NOT NULL THEN md5(u.clause_id || '/' || p.clause_unit_id) END AS new_parent FROM {_UNITS} u LEFT JOIN (SELECT clause_unit_id, lower(trim(clause_unit_id, ' \t')) AS k, clause_id AS pc FROM {_UNITS}) p ON lower(trim(u.parent_unit_id, ' \t')) = p.k AND u.clause_id = p.pc""")
def graph_ingest(spark, d):
    """Parents and children ingested under ids that follow from their keys, so that a child knows its parent's id without waiting for it; parents of other groups are skipped."""
    u = _latest_units(spark, d).select("clause_unit_id", "clause_id", key(F.col("parent_unit_id")).alias("pk"))
    p = u.select(F.col("clause_unit_id").alias("pid"), key(F.col("clause_unit_id")).alias("k"), F.col("clause_id").alias("pc"))
    new = lambda c: F.md5(F.concat("clause_id", F.lit("/"), c))
    return u.join(p, (F.col("pk") == F.col("k")) & (F.col("clause_id") == F.col("pc")), "left").select(new("clause_unit_id").alias("new_id"), F.when(F.col("pid").isNotNull(), new("pid")).alias("new_parent"))


# --- dates, rules, models ---


@query("SELECT entity_id, CASE WHEN state IN ('OH', 'AL') THEN 24 WHEN state = 'MN' THEN 12 END AS months, CASE WHEN state IN ('OH', 'AL') THEN DATE '2026-03-31' WHEN state = 'MN' THEN DATE '2027-03-31' END::VARCHAR AS next_due FROM entities")
def date_intervals(spark, d):
    """Months of an interval in words, and the next due date after a day."""
    words = F.when(F.col("state").isin("OH", "AL"), "every 2 years").when(F.col("state") == "MN", "annually").otherwise("once")
    m = D.interval_months(words)
    start, today = F.to_date(F.lit("2022-03-31")), F.when(F.col("state") == "MN", F.to_date(F.lit("2026-06-30"))).otherwise(F.to_date(F.lit("2025-06-30")))
    return table(spark, d, "entities").select("entity_id", m.alias("months"), D.next_due(start, m, today).cast("string").alias("next_due"))


@query("SELECT document_id, coalesce(expiration_date < DATE '2026-06-30', false) AS overdue, CASE WHEN expiration_date < DATE '2026-06-30' THEN DATE '2026-06-30' - expiration_date END AS days_over, coalesce(expiration_date - DATE '2026-06-30' BETWEEN 0 AND 60, false) AS soon FROM documents")
def date_windows(spark, d):
    """Overdue, days overdue and due within sixty days of a day."""
    left = D.days_left(F.col("expiration_date"), F.to_date(F.lit("2026-06-30")))
    return table(spark, d, "documents").select("document_id", F.coalesce(left < 0, F.lit(False)).alias("overdue"), F.when(left < 0, -left).cast("long").alias("days_over"), F.coalesce(left.between(0, 60), F.lit(False)).alias("soon"))


_OPS = [("equals", "n_chars", "100"), ("not_equals", "lang", "en"), ("greater_than", "n_chars", "3000"), ("at_least", "n_chars", "3000"), ("less_than", "n_chars", "3000"), ("at_most", "n_chars", "3000"), ("in", "governing_state", "AZ, NY"), ("contains", "title", "insur"), ("exists", "lang", "")]


@query("""SELECT doc_id, concat_ws(',', coalesce((n_chars = 100)::VARCHAR, '?'), coalesce((lang <> 'en')::VARCHAR, '?'), coalesce((n_chars > 3000)::VARCHAR, '?'), coalesce((n_chars >= 3000)::VARCHAR, '?'), coalesce((n_chars < 3000)::VARCHAR, '?'), coalesce((n_chars <= 3000)::VARCHAR, '?'), coalesce((governing_state IN ('AZ', 'NY'))::VARCHAR, '?'), coalesce(contains(lower(title), 'insur')::VARCHAR, '?'), (lang IS NOT NULL)::VARCHAR) AS verdicts FROM documents""")
def rule_predicates(spark, d):
    """All nine predicates by name, unknown values as '?'."""
    test = lambda op, c, w: F.coalesce(rules.compare(F.lit(op), F.col(c).cast("string"), F.lit(w)).cast("string"), F.lit("?"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", *[test(*x) for x in _OPS]).alias("verdicts"))


@query("""SELECT source || '/' || coalesce(lang, 'none') AS tree_id, CASE WHEN bool_or(t) THEN 'false' WHEN bool_or(t IS NULL) THEN 'unknown' ELSE 'true' END AS verdict FROM (SELECT source, lang, n_chars > 6000 AS t FROM documents) GROUP BY 1""")
def rule_verdicts(spark, d):
    """Negated alternatives: none of a group's documents may be long."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", F.coalesce("lang", F.lit("none"))).alias("tree_id"), "doc_id", "n_chars")
    root = docs.select("tree_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("OR").alias("op"), F.lit(None).cast("boolean").alias("truth"), F.lit(True).alias("negated")).distinct()
    leaf = docs.select("tree_id", F.col("doc_id").cast("string").alias("node_id"), F.lit("root").alias("parent_id"), F.lit(None).cast("string").alias("op"), (F.col("n_chars") > 6000).alias("truth"), F.lit(False).alias("negated"))
    return rules.evaluate(root.unionAll(leaf)).where("node_id = 'root'").select("tree_id", "verdict")


def _busy(prompt: str) -> str:
    if "Insurance" in prompt:
        raise providers.Busy("rate limit")
    return prompt.split(" - ")[0].upper()


def _spare(prompt: str) -> str:
    return "spare " + prompt.split(" - ")[0]


@query("SELECT doc_id, CASE WHEN contains(title, 'Insurance') THEN 'spare ' || split_part(title, ' - ', 1) ELSE upper(split_part(title, ' - ', 1)) END AS answer, CASE WHEN contains(title, 'Insurance') THEN 1 ELSE 0 END AS provider FROM documents")
def model_failover(spark, d):
    """Answers of the first provider that is not busy (stand-ins here)."""
    a = providers.answered(F.col("title"), [_busy, _spare])
    return table(spark, d, "documents").select("doc_id", a.alias("a")).select("doc_id", "a.answer", "a.provider")


def _fenced(prompt: str) -> str:
    """A stand-in that answers as models do: in a fence, with a quote inside a value and without the end."""
    kind, _, rest = prompt.partition(" - ")
    return f'```json\n{{"kind": "the "{kind}" one", "words": [{", ".join(str(len(w)) for w in rest.split())}'


@query("""SELECT doc_id, 'the "' || split_part(title, ' - ', 1) || '" one' AS kind, list_sum(list_transform(list_filter(string_split(substring(title, instr(title, ' - ') + 3), ' '), lambda w: w <> ''), lambda w: length(w)))::BIGINT AS letters FROM documents""")
def model_structured(spark, d):
    """Structured answers: read by a schema after repair."""
    a = providers.structured(F.col("title"), [_fenced], "kind string, words array<int>")
    return table(spark, d, "documents").select("doc_id", a.alias("a")).select("doc_id", "a.kind", F.aggregate("a.words", F.lit(0).cast("long"), lambda x, y: x + y).alias("letters"))


@query(f"SELECT document_id, ((n - 1) // 3)::INTEGER AS chunk, string_agg(clause_id, ',' ORDER BY n) AS ids FROM (SELECT document_id, clause_id, row_number() OVER (PARTITION BY document_id ORDER BY clause_id) AS n FROM {_LC} WHERE document_id IS NOT NULL) GROUP BY 1, 2")
def model_batches(spark, d):
    """Clauses of a document in batches of three, as they are sent to a model."""
    b = relational.chunked(_latest_clauses(spark, d).where("document_id IS NOT NULL"), "document_id", [F.asc("clause_id")], 3, ["clause_id"])
    return b.select("document_id", "chunk", F.array_join(F.transform("rows", lambda x: x["clause_id"]), ",").alias("ids"))


@query("SELECT entity_id || '.' || ext AS file_name, 'Agreement of ' || name || chr(10) || 'It ends (soon).' AS file_text FROM entities, (VALUES ('txt'), ('docx'), ('pdf')) t(ext)")
def scan_extracted(spark, d):
    """Text of plain, word-processor and PDF files (made here from names, the PDF streams deflated)."""
    e = table(spark, d, "entities").select("entity_id", F.concat(F.lit("Agreement of "), "name", F.lit("\nIt ends (soon).")).alias("t"))

    @F.pandas_udf("binary")
    def packed(ext: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([files.packed(x, t) for x, t in zip(ext, text)])

    f = e.select("entity_id", "t", F.explode(F.array(*[F.lit(x) for x in ("txt", "docx", "pdf")])).alias("extension"))
    f = f.select(F.concat_ws(".", "entity_id", "extension").alias("file_name"), "extension", packed("extension", "t").alias("content"))
    return files.extracted(f).select("file_name", "file_text")


# --- queues and streams ---


@query(f"""SELECT upload_id, CASE WHEN t = '' THEN 'failed' ELSE 'done' END AS extraction_status, CASE WHEN t = '' THEN 'empty' END AS error, length(t) % 1000 AS checksum, retry_count + CASE WHEN t = '' THEN 1 ELSE 0 END AS retry_count FROM (SELECT upload_id, coalesce(file_text, '') AS t, retry_count FROM {_UPLOADS})""")
def stream_drained(spark, d):
    """Uploads put into a queue in two batches, drained as a stream until it is empty; a failing job is its own failure and is counted for its next try."""
    home = scratch_folder(spark, "queue")
    u = _latest_uploads(spark, d).select("upload_id", "file_text", "retry_count")
    for n in range(2):
        u.where(F.pmod(F.xxhash64("upload_id"), F.lit(2)) == n).write.mode("append").parquet(f"{home}/in")

    def work(text):
        if not text:
            raise ValueError("empty")
        return str(len(text) % 1000)

    jobs.drain(jobs.queue(spark, f"{home}/in", u.schema), lambda df: jobs.isolated(df, work, "file_text").drop("file_text"), f"{home}/out", f"{home}/state").awaitTermination()
    done = spark.read.parquet(f"{home}/out").withColumn("retry_count", F.col("retry_count").cast("int"))
    again = jobs.failed_again(done).withColumn("extraction_status", F.lit("failed"))
    return done.where("extraction_status = 'done'").unionByName(again).select("upload_id", "extraction_status", "error", F.coalesce(F.col("result").cast("long"), F.lit(0)).alias("checksum"), "retry_count")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """The event table read as a stream: windowed counts, each micro-batch replacing the result."""
    home = scratch_folder(spark, "windows")
    schema = table(spark, d, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = jobs.event_counts(ev.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "6 hours")

    def keep(df, n):
        df.write.mode("overwrite").parquet(f"{home}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events")


@query("SELECT entity_id, name FROM entities")
def scan_cached(spark, d):
    """A table through the read cache: the second reader gets the first one's load."""
    cache = ReadCache()
    first = cache.get("entities", lambda: table(spark, d, "entities").select("entity_id", "name"))
    again = cache.get("entities", lambda: table(spark, d, "entities").limit(0))
    cache.drop("entities")
    return first.join(again.select("entity_id"), "entity_id", "left_semi")
