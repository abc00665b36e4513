"""SQL that gives the same rows as the catalog's queries.

``FOLD`` stands for NFKC and case folding: of the characters in the driver's texts, all composed letters of
western languages, it changes more than lower case does only for the sharp s.
"""

from __future__ import annotations

from quire.functions import text as T
from quire.operators import retrieval as R

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
PATTERN = T.TOKEN.replace("'", "''")
MAX_CHARS = 200  # of a contract's chunks


def fold(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


def stem(t: str) -> str:
    irregular = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in T.IRREGULAR.items())
    return f"""CASE {irregular}
  WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y'
  WHEN {t} LIKE '%ing' AND length({t}) > 5 THEN left({t}, length({t}) - 3)
  WHEN {t} LIKE '%ed' AND length({t}) > 4 THEN left({t}, length({t}) - 2)
  WHEN regexp_matches({t}, '(sses|xes|zes|ches|shes)$') AND length({t}) > 4 THEN left({t}, length({t}) - 2)
  WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND length({t}) > 3 THEN left({t}, length({t}) - 1)
  ELSE {t} END"""


def tokens(text: str) -> str:
    """The list of a text's terms."""
    return f"list_transform(list_filter(regexp_extract_all({fold(text)}, '{PATTERN}'), lambda t: length(t) > 1 AND t NOT IN ({STOP})), lambda t: {stem('t')})"


def token_rows(key: str, table: str, name: str = "stems", text: str = "text") -> str:
    return f"{name} AS (SELECT {key} AS id, unnest({tokens(text)}) AS term FROM {table})"


def normal(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({fold(text)}, '[\\p{{P}}\\p{{Z}}]', ' ', 'g'), '\\s+', ' ', 'g'))"


# retrieval


def bm25(question: str, table: str, key: str) -> str:
    """CTEs up to ``scored``: query_id, chunk_id, score."""
    return f"""{token_rows('doc_id', 'documents')},
asked AS (SELECT DISTINCT id AS query_id, term FROM (SELECT {key} AS id, unnest({tokens(question)}) AS term FROM {table})),
lens AS (SELECT d.doc_id AS id, count(s.term) AS len FROM documents d LEFT JOIN stems s ON s.id = d.doc_id GROUP BY d.doc_id),
facts AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
tf AS (SELECT id, term, count(*) AS tf FROM stems GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT a.query_id, tf.id AS chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM asked a JOIN tf USING (term) JOIN df USING (term) JOIN lens ON lens.id = tf.id CROSS JOIN facts GROUP BY a.query_id, tf.id)"""


BM25 = f"""WITH {bm25('text', 'benchmark', 'item_id')},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5"""

HEADING = """(len(regexp_extract_all({x}, '[A-Za-z]+')) BETWEEN 1 AND 8 AND NOT regexp_matches({x}, '[.!?]')
  AND (regexp_matches({x}, '^\\s*\\d+\\.\\s+.+$') OR upper({x}) = {x} OR len(list_filter(regexp_extract_all({x}, '[A-Za-z]+'), lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0))"""


def passages(key: str, table: str, text: str = "text") -> str:
    """CTEs up to ``passages``: id, pos, passage."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    lead = HEADING.format(x="trim(x)")
    return f"""parts AS (SELECT {key} AS id, unnest(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS n FROM {table}),
lined AS (SELECT id, n, string_split({strip('part')}, chr(10)) AS lines FROM parts),
cut AS (SELECT id, n, lines, list_position(list_transform(lines[:len(lines) - 1], lambda x: {lead} OR trim(x) = ''), false) AS stop FROM lined),
bodies AS (SELECT id, n, {strip("array_to_string(lines[CASE WHEN coalesce(stop, 0) > 0 THEN stop ELSE len(lines) END:], chr(10))")} AS passage FROM cut),
passages AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS pos, passage FROM bodies WHERE passage <> '')"""


PASSAGES = f"WITH {passages('doc_id', 'documents')} SELECT id AS doc_id, pos, passage FROM passages"


def expansion(question: str) -> str:
    cases = ", ".join(
        "CASE WHEN regexp_matches({q}, '(?i){rule}') THEN '{words}' END".format(q=question, rule=rule, words=words) for rule, words in R.EXPANSIONS
    )
    return f"concat_ws(' ', {cases})"


def _answers() -> str:
    generic = ", ".join(f"'{w}'" for w in R.GENERIC)
    shared = lambda c: f"len(list_intersect(terms, {c}))"
    return f"""WITH q AS (SELECT item_id AS query_id, text AS question, {expansion('text')} AS more FROM benchmark WHERE trim(text) <> ''),
wide AS (SELECT *, concat_ws(' ', question, more) AS wide FROM q),
{bm25('wide', 'wide', 'query_id')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored WHERE score > 0.05),
named AS (SELECT *, {tokens('question')} AS original, {tokens('wide')} AS expanded, {tokens('more')} AS concepts, {tokens("array_to_string(regexp_extract_all(question, '\\b[A-Z][A-Za-z0-9''-]*\\b')[2:], ' ')")} AS names FROM wide),
terms AS (SELECT *, list_filter(list_distinct(original), lambda t: NOT list_contains(names, t) AND t NOT IN ({generic})) AS content FROM named),
chunks AS (SELECT d.doc_id AS id, d.text, {tokens("'doc_' || d.doc_id || ' ' || d.source || '.pdf'")} AS place, 'doc_' || d.doc_id AS document_id, d.source || '.pdf' AS file_name FROM documents d WHERE d.doc_id IN (SELECT chunk_id FROM ranked WHERE rank <= 5)),
{passages('id', 'chunks')},
rows AS (SELECT r.query_id, r.chunk_id, r.score, r.rank, p.pos, p.passage, list_distinct({tokens('p.passage')}) AS terms, t.* EXCLUDE (query_id), c.place, c.document_id, c.file_name
  FROM ranked r JOIN passages p ON p.id = r.chunk_id JOIN terms t ON t.query_id = r.query_id JOIN chunks c ON c.id = r.chunk_id WHERE r.rank <= 5),
valued AS (SELECT *, round(3.0 * {shared('original')} + {shared('expanded')} + 1.5 * {shared('concepts')} + 0.15 * score + least(len(terms), 24) / 100
    - CASE WHEN len(terms) < 3 AND NOT regexp_matches(passage, '\\d|[$£€₹]') THEN 1.5 ELSE 0.0 END, 9) AS value,
    regexp_matches(question, '{R.COMPARISON}') AS compares, len(list_intersect(original, place)) > 0 AS known
  FROM rows WHERE {shared('expanded')} > 0 AND CASE WHEN len(concepts) > 0 THEN {shared('concepts')} > 0 ELSE {shared('content')} >= greatest(1, ceil(len(content) * 0.6)) END),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id, passage ORDER BY value DESC, rank, pos) = 1),
counted AS (SELECT *, len(list_distinct(list(CASE WHEN known THEN document_id END) OVER (PARTITION BY query_id))) AS n_known FROM best),
able AS (SELECT * FROM counted WHERE NOT compares OR n_known < 2 OR known),
by_doc AS (SELECT * FROM able QUALIFY NOT compares OR row_number() OVER (PARTITION BY query_id, document_id ORDER BY value DESC, rank, pos, passage) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rank, pos, passage) AS k FROM by_doc),
picked AS (SELECT query_id, string_agg(passage, chr(10) ORDER BY k) AS answer, string_agg(concat_ws('|', CAST(chunk_id AS VARCHAR), document_id, file_name, '1', CAST(chunk_id AS VARCHAR)), ';' ORDER BY k) AS cited
  FROM top WHERE k = 1 OR (compares AND k = 2) GROUP BY query_id HAVING NOT any_value(compares) OR count(*) = 2)
SELECT b.item_id AS query_id, b.text AS question, coalesce(p.answer, '{R.ABSTAIN}') AS answer, p.cited, p.query_id IS NULL AS abstained FROM benchmark b LEFT JOIN picked p ON p.query_id = b.item_id"""


ANSWERS = _answers()

# recognition errors: distances over characters, each written as one byte, and over words, by their matrix

OCR = """WITH RECURSIVE t AS (SELECT item_id, nfc_normalize(text) AS text FROM benchmark),
p AS (SELECT a.item_id AS case_id, a.text AS r, b.text AS p, list_filter(regexp_split_to_array(trim(regexp_replace(a.text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS rw, list_filter(regexp_split_to_array(trim(regexp_replace(b.text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS pw FROM t a JOIN t b ON b.item_id = a.item_id + 1),
alphabet AS (SELECT list(c ORDER BY c) AS cs FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM t)),
coded AS (SELECT p.*, array_to_string(list_transform(string_split(r, ''), lambda c: chr(CAST(list_position(cs, c) AS INTEGER))), '') AS rc, array_to_string(list_transform(string_split(p.p, ''), lambda c: chr(CAST(list_position(cs, c) AS INTEGER))), '') AS pc FROM p, alphabet),
m(case_id, i, row) AS (SELECT case_id, 0, range(0, len(pw) + 1) FROM p UNION ALL
  SELECT m.case_id, i + 1, list_reduce(list_transform(range(1, len(pw) + 1), lambda j: [j]), lambda acc, x: list_append(acc, least(acc[-1] + 1, row[x[1] + 1] + 1, row[x[1]] + CASE WHEN rw[i + 1] = pw[x[1]] THEN 0 ELSE 1 END)), [CAST(i + 1 AS BIGINT)])
  FROM m JOIN p USING (case_id) WHERE i < len(rw)),
e AS (SELECT case_id, CAST(length(r) AS INTEGER) AS reference_characters, CAST(length(coded.p) AS INTEGER) AS predicted_characters, CAST(levenshtein(rc, pc) AS INTEGER) AS character_errors, CAST(len(rw) AS INTEGER) AS reference_words, CAST(len(pw) AS INTEGER) AS predicted_words, CAST(row[-1] AS INTEGER) AS word_errors FROM coded JOIN m USING (case_id) WHERE i = len(rw))
"""
OCR_METRICS = OCR + "SELECT *, character_errors / reference_characters AS cer, word_errors / reference_words AS wer FROM e"
OCR_SUMMARY = OCR + """SELECT CAST(sum(character_errors) AS BIGINT) AS character_errors, CAST(sum(reference_characters) AS BIGINT) AS reference_characters, CAST(sum(word_errors) AS BIGINT) AS word_errors, CAST(sum(reference_words) AS BIGINT) AS reference_words,
  sum(character_errors) / sum(reference_characters) AS cer, sum(word_errors) / sum(reference_words) AS wer FROM e"""

# contracts, in four wordings by the order's key; what the rules find follows from the wording

PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR)"
LAND = "'Land ' || chr(n_nationkey + 65)"
DAYS = "CAST(o_orderkey % 60 + 10 AS VARCHAR)"
ORDERS = f"""o AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, o_orderkey % 4 AS v, {DAYS} AS days, {PRICE} AS price, {LAND} AS land, CAST(o_orderkey % 9 + 1 AS VARCHAR) AS share,
  strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(day(o_orderdate) AS VARCHAR) || ' ' || monthname(o_orderdate) || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS long, strftime(o_orderdate, '%m/%d/%Y') AS local
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
# (kind, the text in each wording); {x} stands for a column of the order
WORDINGS: list[tuple[str, tuple[str, str, str, str]]] = [
    ("title", ("SERVICES AGREEMENT",) * 4),
    (
        "paragraph",
        (
            "This Agreement is entered into as of {iso} between Acme Works Ltd and Bolt Holdings Inc.",
            "This Agreement is made on {long} by and between Acme Works Ltd and Bolt Holdings Inc.",
            "The effective date is {local}.\nClient: Acme Works Ltd\nVendor: Bolt Holdings Inc", "This paper binds both sides."
        )
    ),
    (
        "paragraph",
        (
            "The initial term is for a period of {days} months. It renews for successive terms of one year unless ended.",
            "The term shall continue for {days} days.", "This Agreement shall commence at once and", ""
        )
    ),
    ("paragraph", ("", "", "continue for twelve months.", "")),
    (
        "paragraph",
        (
            "Either party may request termination on {days} days written notice.",
            "At least thirty (30) days prior written notice is required to cancel.", "On non-renewal: 60 days notice.",
            "No early end."
        )
    ),
    ("heading", ("FEES",) * 4),
    (
        "paragraph",
        (
            "The customer shall pay USD {price}. Invoices are due within 30 days.", "Payment of USD {price} is due upon receipt.",
            "Net 45 from the invoice. The price is EUR {price}.", "The rate is {share}% of revenue."
        )
    ),
    (
        "paragraph",
        (
            "This Agreement is governed by the laws of {land}, without exception.",
            "The laws of {land} shall govern this Agreement.",
            "This Agreement shall be governed by and construed in accordance with the laws of",
            "Governed by the laws of {land} and the courts there."
        )
    ),
    ("paragraph", ("", "", "the State of {land}.", "Official stamp applied")),
    ("signature", ("Signed by the parties", "For Acme: A. Smith", "Signed by the parties", "")),
]
# field: for each wording (value, confidence, blocks cited); None where nothing is found
CLAUSES: dict[str, list[tuple[str, float, str] | None]] = {
    "effective_date": [("{iso}", 0.94, "b1"), ("{long}", 0.94, "b1"), ("{local}", 0.72, "b1"), None],
    "initial_term": [("{days} months", 0.89, "b2"), ("{days} days", 0.89, "b2"), ("twelve months", 0.89, "b3"), None],
    "renewal_terms": [("It renews for successive terms of one year unless ended.", 0.87, "b2"), None, None, None],
    "termination_notice": [
        ("{days} days written notice", 0.91, "b4"), ("At least thirty (30) days prior written notice", 0.91, "b4"),
        ("60 days notice", 0.91, "b4"), None
    ],
    "governing_law": [("{land}", 0.95, "b7"), ("{land}", 0.95, "b7"), ("State of {land}", 0.95, "b8"), ("{land}", 0.95, "b7")],
    "payment_terms": [
        ("Invoices are due within 30 days.", 0.86, "b6"), ("FEES Payment of USD {price} is due upon receipt.", 0.86, "b5,b6"),
        ("FEES Net 45 from the invoice.", 0.86, "b5,b6"), None
    ],
}
BOTH, PAIR = "Acme Works Ltd and Bolt Holdings Inc", "Acme Works Ltd, Bolt Holdings Inc"
OTHERS: dict[str, list[tuple[str, float, str] | None]] = {
    "parties": [(f"{BOTH}, {PAIR}", 0.94, "b1"), (f"{BOTH}, {PAIR}", 0.94, "b1"), (PAIR, 0.88, "b1"), None],
    "fees": [("USD {price}", 0.88, "b6"), ("USD {price}", 0.88, "b6"), ("EUR {price}", 0.88, "b6"), ("{share}%", 0.88, "b6")],
    "signatures_present": [("true", 0.94, "b9"), ("true", 0.94, "b9"), ("true", 0.94, "b9"), None],
    "stamps_present": [None, None, None, ("true", 0.80, "b8")],
}
LOCAL = "Numeric date format may be locale-ambiguous."
MISSING = "No supported value found by deterministic rules."
NO_TEXT = "A visual signature block was detected, but it has no quotable text evidence."


def filled(text: str) -> str:
    """A wording as an SQL expression."""
    out = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for c in ("iso", "long", "local", "days", "price", "land", "share"):
        out = out.replace("{" + c + "}", f"' || {c} || '")
    return out


def _blocks() -> str:
    rows = [
        f"SELECT doc, {i} AS i, '{kind}' AS kind, CASE v " + " ".join(
            f"WHEN {v} THEN {filled(t)}" for v, t in enumerate(texts)
        ) + " END AS text FROM o" for i, (kind, texts) in enumerate(WORDINGS)
    ]
    return f"{ORDERS},\nb AS ({' UNION ALL '.join(rows)})"


BLOCKS = _blocks()


def _found(fields: dict, missing: bool) -> str:
    rows = []
    for field, by in fields.items():
        for v, got in enumerate(by):
            if got:
                value, confidence, cited = got
                local = value == "{local}"
                rows.append(
                    f"SELECT doc AS document_id, '{field}' AS field, {filled(value)} AS value, '{'needs_review' if local else 'extracted'}' AS status, {confidence} AS confidence, " + (
                        f"'{LOCAL}'" if local else "CAST(NULL AS VARCHAR)"
                    ) + f" AS reason, '{cited}' AS cited FROM o WHERE v = {v}"
                )
            elif missing:
                blank = field == "signatures_present"
                status, confidence, reason = ("needs_review", 0.45, NO_TEXT) if blank else ("missing", 0.0, MISSING)
                rows.append(f"SELECT doc, '{field}', NULL, '{status}', {confidence}, '{reason}', '' FROM o WHERE v = {v}")
    return " UNION ALL ".join(rows)


def clause_fields() -> str:
    return f"WITH {ORDERS} SELECT document_id, field, value, status, CAST(confidence AS DOUBLE) AS confidence, reason, cited FROM ({_found(CLAUSES, False)})"


def validated_fields() -> str:
    return f"WITH {ORDERS} SELECT document_id, field, value, status, CAST(confidence AS DOUBLE) AS confidence, reason, cited FROM ({_found({**CLAUSES, **OTHERS}, True)})"


FEES = f"WITH {ORDERS} SELECT doc AS document_id, CASE v WHEN 2 THEN 'EUR ' || price WHEN 3 THEN share || '%' ELSE 'USD ' || price END AS fee FROM o"

_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
WINDOWS = f"""WITH {BLOCKS},
u AS (SELECT doc, i, {_FLAT} AS flat, kind = 'heading' OR kind = 'title' AS head, row_number() OVER (PARTITION BY doc ORDER BY i) AS n FROM b WHERE trim(text) <> ''),
stops AS (SELECT a.doc, a.n, min(x.n) AS stop FROM u a JOIN u x ON x.doc = a.doc AND x.n > a.n AND x.head GROUP BY a.doc, a.n),
w AS (SELECT a.doc, a.i AS start, k.n - a.n + 1 AS size, a.n AS first, k.n AS last FROM u a JOIN u k ON k.doc = a.doc AND k.n BETWEEN a.n AND a.n + 4 LEFT JOIN stops s ON s.doc = a.doc AND s.n = a.n WHERE s.stop IS NULL OR k.n < s.stop)
SELECT w.doc AS document_id, 'b' || w.start AS start, CAST(w.size AS INTEGER) AS size, string_agg(u.flat, ' ' ORDER BY u.n) AS text, string_agg('b' || u.i || ':' || length(u.flat), ',' ORDER BY u.n) AS segments
FROM w JOIN u ON u.doc = w.doc AND u.n BETWEEN w.first AND w.last GROUP BY w.doc, w.start, w.size"""


def chunks(blocks: str, limit: int) -> str:
    """The chunks of ``blocks`` (doc, file, i, kind, text; one page): texts are cut into units, which one
    recursion then packs, a unit a step."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    half = limit // 2
    window = f"substr(rest, {half + 1}, {limit + 1 - half})"
    at = f"CASE WHEN regexp_matches({window}, '[ \\n]') THEN {half} + length({window}) - length(regexp_extract({window}, '[^ \\n]*$')) - 1 ELSE {limit} END"
    room = f"(len(texts) > 0 AND list_sum(list_transform(texts, lambda t: length(t))) + 2 * len(texts) + length(u.text) <= {limit})"
    around = f"(len(ctexts) > 0 AND list_sum(list_transform(ctexts, lambda t: length(t))) + 2 * len(ctexts) + length(u.text) <= {limit})"
    closed = "CASE WHEN len(texts) > 0 THEN list_append(done, struct_pack(ids := ids, texts := texts)) ELSE done END"
    none = "CAST([] AS VARCHAR[])"

    def case(head: str, atomic_room: str, atomic: str, prose_room: str, prose: str, head_room: str) -> str:
        """By the kind of unit: a heading among headings or another, an atom that joins or stands alone, prose that joins or not."""
        return f"CASE WHEN u.head THEN CASE WHEN heads AND {room} THEN {head_room} ELSE {head} END WHEN u.atomic THEN CASE WHEN {room} OR (heads AND len(texts) > 0) THEN {atomic_room} ELSE {atomic} END WHEN {room} THEN {prose_room} ELSE {prose} END"

    joined = lambda c, x: f"list_append({c}, u.{x})"
    alone = lambda x: f"[u.{x}]"
    with_context = lambda c, x: f"CASE WHEN {around} THEN list_append({c}, u.{x}) ELSE [u.{x}] END"
    new = lambda c, x, ctx: case(alone(x), none, none, joined(c, x), with_context(ctx, x), joined(c, x))
    kept = lambda c, x, ctx: f"CASE WHEN u.head THEN CASE WHEN heads AND {room} THEN list_append({c}, u.{x}) ELSE [u.{x}] END ELSE {ctx} END"
    whole = lambda ids, texts: f"struct_pack(ids := {ids}, texts := {texts})"
    done = case(
        closed, f"list_append(done, {whole(joined('ids', 'id'), joined('texts', 'text'))})",
        f"list_append({closed}, {whole('[u.id]', '[u.text]')})", "done", closed, "done"
    )
    return f"""
h AS (SELECT doc, file, i, {strip('text')} AS text, kind IN ('table', 'stamp', 'signature') AS atomic, kind = 'title' OR (kind = 'heading' AND upper(text) = text AND len(regexp_extract_all(text, '[A-Za-z]+')) BETWEEN 1 AND 12 AND NOT regexp_matches(text, '[.;:]$')) AS head FROM {blocks}),
cuts(doc, file, i, k, piece, rest, atomic, head) AS (
  SELECT doc, file, i, 0, CAST(NULL AS VARCHAR), text, atomic, head FROM h WHERE text <> '' UNION ALL
  SELECT doc, file, i, k + 1, CASE WHEN length(rest) <= {limit} OR atomic OR head THEN rest ELSE {strip(f'left(rest, {at})')} END, CASE WHEN length(rest) <= {limit} OR atomic OR head THEN '' ELSE {strip(f'substr(rest, {at} + 1)')} END, atomic, head FROM cuts WHERE rest <> ''),
units AS (SELECT doc, file, 'b' || i AS id, piece AS text, atomic, head, row_number() OVER (PARTITION BY doc ORDER BY i, k) AS n FROM cuts WHERE piece <> ''),
f(doc, n, ids, texts, heads, cids, ctexts, done) AS (
  SELECT DISTINCT doc, CAST(0 AS BIGINT), {none}, {none}, false, {none}, {none}, CAST([] AS STRUCT(ids VARCHAR[], texts VARCHAR[])[]) FROM units UNION ALL
  SELECT f.doc, f.n + 1, {new('ids', 'id', 'cids')}, {new('texts', 'text', 'ctexts')}, u.head, {kept('ids', 'id', 'cids')}, {kept('texts', 'text', 'ctexts')}, {done}
  FROM f JOIN units u ON u.doc = f.doc AND u.n = f.n + 1),
ends AS (SELECT doc, {closed} AS done FROM f QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1),
listed AS (SELECT doc, unnest(done) AS c, generate_subscripts(done, 1) AS n FROM ends)
SELECT doc || ':p1:c' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS chunk_id, doc AS document_id, array_to_string(list_filter(c.ids, lambda x, j: list_position(c.ids, x) = j), ',') AS block_ids, array_to_string(c.texts, chr(10) || chr(10)) AS text, CAST(n AS INTEGER) AS ord FROM listed"""


CONTRACT_CHUNKS = f"WITH RECURSIVE {BLOCKS}, cb AS (SELECT doc, doc || '.pdf' AS file, i, kind, text FROM b)," + chunks("cb", MAX_CHARS)
DOCUMENT_CHUNKS = "WITH RECURSIVE db AS (SELECT CAST(doc_id AS VARCHAR) AS doc, source || '.pdf' AS file, 0 AS i, 'paragraph' AS kind, text FROM documents)," + chunks("db", 1200)

# pages: a line item is a block, whose text, size and place follow from its part and supplier

NUMBERED = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS n FROM lineitem)"
PAGE_BLOCKS = """blocks AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, n AS pos, CASE WHEN l_partkey % 7 = 3 THEN 18.0 ELSE 10.0 END AS font,
  CASE l_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '1. ' || p_name WHEN 3 THEN p_name || ' agreement' WHEN 4 THEN 'Page ' || l_linenumber || ' of 7' WHEN 5 THEN 'a | b | ' || p_name ELSE 'Signed by ' || p_name END AS text,
  CASE l_suppkey % 5 WHEN 0 THEN 40.0 WHEN 1 THEN 280.0 WHEN 2 THEN 40.0 WHEN 3 THEN 40.0 ELSE 320.0 END AS x0, CASE l_suppkey % 5 WHEN 0 THEN 560.0 WHEN 1 THEN 320.0 WHEN 2 THEN 260.0 WHEN 3 THEN 260.0 ELSE 540.0 END AS x1,
  CASE WHEN l_partkey % 7 = 4 THEN 760.0 ELSE ((l_linenumber * 97 + l_partkey) % 13) * 55.0 + 30 END AS y0 FROM """ + NUMBERED + " JOIN part ON l_partkey = p_partkey)"
_PIPES = "(length(text) - length(replace(text, '|', '')) >= 2)"
_STAMP, _SIGNED, _TITLE = "(?i)\\b(stamp|official seal|approved|certified)\\b", "(?i)\\b(signature|signed by|authori[sz]ed signatory|witness|sign here)\\b", "(?i)\\b(agreement|contract|report|statement|proposal)\\b"
KINDS = f"""{PAGE_BLOCKS},
sized AS (SELECT *, y0 + 40 AS y1, median(font) OVER (PARTITION BY doc) AS body, row_number() OVER (PARTITION BY doc ORDER BY y0, x0, pos) = 1 AS top FROM blocks),
kinds AS (SELECT *, length(text) AS n, CASE WHEN regexp_matches(text, '{_STAMP}') AND length(text) <= 100 THEN 'stamp' WHEN {_PIPES} THEN 'table' WHEN regexp_matches(text, '{_SIGNED}') THEN 'signature'
  WHEN y0 >= 688 AND length(text) <= 120 THEN 'footer' WHEN length(text) <= 180 AND y0 <= 240 AND (font >= body * 1.65 OR (top AND (font >= body * 1.28 OR regexp_matches(text, '{_TITLE}')))) THEN 'title'
  WHEN length(text) <= 180 AND (font >= body * 1.12 OR regexp_matches(text, '^(?:\\d+(?:\\.\\d+)*|[A-Z]|[IVX]+)[.)]?\\s+\\S') OR (length(text) >= 4 AND upper(text) = text AND regexp_matches(text, '\\p{{L}}')) OR text LIKE '%:') THEN 'heading' ELSE 'paragraph' END AS kind FROM sized)"""
CLASSIFY = f"WITH {KINDS} SELECT doc AS document_id, pos, kind, CAST(n AS INTEGER) AS char_count FROM kinds"
ORDER = f"""{KINDS},
placed AS (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, kind <> 'footer' AND ((x0 <= 276 AND x1 >= 324) OR x1 - x0 >= 420) AS anchor FROM kinds),
cuts AS (SELECT doc, list(struct_pack(pos := pos, y := y) ORDER BY y0, x0, pos) AS cuts FROM placed WHERE anchor GROUP BY doc),
banded AS (SELECT p.*, CASE WHEN anchor THEN list_position(list_transform(cuts, lambda c: c.pos), pos) - 1
  ELSE list_filter(range(0, coalesce(len(cuts), 0) + 1), lambda i: i = coalesce(len(cuts), 0) OR ((i = 0 OR cuts[i].y <= p.y) AND p.y < cuts[i + 1].y))[1] END AS band, CASE WHEN x < 282 THEN 0 WHEN x > 318 THEN 2 ELSE 1 END AS side FROM placed p LEFT JOIN cuts USING (doc)),
sided AS (SELECT *, kind <> 'footer' AND NOT anchor AS flow, median(x) FILTER (kind <> 'footer' AND NOT anchor AND side = 2) OVER (PARTITION BY doc, band) - median(x) FILTER (kind <> 'footer' AND NOT anchor AND side = 0) OVER (PARTITION BY doc, band) >= 120 AS columns FROM banded),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY kind = 'footer', CASE WHEN kind = 'footer' THEN 0 ELSE band END, kind <> 'footer' AND anchor, CASE WHEN flow AND coalesce(columns, false) THEN side ELSE 0 END, CASE WHEN kind = 'footer' THEN 0 ELSE y0 END, x0, pos) - 1 AS INTEGER) AS reading_order FROM sided)"""
READING_ORDER = f"WITH {ORDER} SELECT doc AS document_id, pos, reading_order FROM ordered"
BLOCK_IDS = f"""WITH {ORDER} SELECT doc AS document_id, pos, reading_order, printf('p%04d-b%04d-', 1, reading_order) || left(sha256(concat_ws('|', sha256(doc), '1', CAST(reading_order AS VARCHAR), 'native', printf('%.3f,%.3f,%.3f,%.3f', CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE), CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE)), text)), 12) AS block_id FROM ordered"""
NATIVE = f"WITH {PAGE_BLOCKS} SELECT doc AS document_id, 1 AS page, sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) >= 40 AS native FROM blocks GROUP BY doc"
