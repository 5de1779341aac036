"""Line-first quality rules.

Every line is judged alone: punctuation, navigation and boilerplate rules mark the
lines that go. A document goes when too many of its words stand in such lines, or
when it is too short or repeats itself too much.

A null text is the empty text; documents without words fail the base rules. A line
without words is neither judged nor removed. Repeated rows are judged one by one,
an empty table gives no rows, and columns beside the id and the text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urnstat.llm.common import find_words, slices, texts_of

#: Base rules: fewest words; most words, in percent, inside repeated windows.
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30
#: A document goes when more than this percentage of its words stand in failing lines.
MOST_LOST = 30

#: Punctuation rules. Fewest words of a line that must hold some sentence mark.
LEAST_SENTENCE = 3
SENTENCE_MARKS = ".!?,;:…。！？、，؟।"
SYMBOLS = "#*$%&|<>"
#: Navigation rule: words that separate menu entries.
SEPARATORS = ("|", "»", "›", ">", "/", "·", "•", "::")
#: Words are compared in A-Z lower case and without these characters at their ends.
EDGES = "\"'()[].,;:!?…«»„“”’-–|"
#: Boilerplate rule, by language: notices, which tell a line by themselves.
NOTICES = {
    "en": ("all rights reserved", "lorem ipsum", "we use cookies", "uses cookies", "accept cookies", "accept all cookies", "enable javascript", "terms of service apply"),
    "de": ("alle rechte vorbehalten", "wir verwenden cookies", "verwendet cookies", "cookies akzeptieren", "javascript aktivieren"),
    "fr": ("tous droits réservés", "nous utilisons des cookies", "utilise des cookies", "accepter les cookies", "activer javascript"),
    "es": ("todos los derechos reservados", "utilizamos cookies", "usamos cookies", "utiliza cookies", "aceptar cookies", "active javascript"),
}
#: Calls and names of house pages, which are ordinary words inside longer prose: a line goes
#: when they make up a ``LEAST_CALLS``-th of its words or more.
CALLS = {
    "en": ("privacy policy", "cookie policy", "terms of use", "terms of service", "terms and conditions", "click here", "read more", "sign up", "log in", "subscribe", "newsletter", "share this", "follow us", "back to top", "contact us"),
    "de": ("datenschutz", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "klicken sie hier", "hier klicken", "mehr lesen", "weiterlesen", "abonnieren", "folgen sie uns", "nach oben", "anmelden"),
    "fr": ("politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "lire la suite", "abonnez-vous", "s'abonner", "suivez-nous", "haut de page", "contactez-nous"),
    "es": ("política de privacidad", "aviso legal", "condiciones de uso", "haga clic aquí", "haz clic aquí", "leer más", "suscríbete", "suscribirse", "síguenos", "volver arriba", "boletín"),
}
LEAST_CALLS = 3
#: Navigation rule: names of menu entries. A line goes when it has ``LEAST_MENU`` of them and they are half of its words.
MENU = {
    "en": ("home", "news", "about", "contact", "login", "register", "search", "sitemap", "menu", "help", "faq", "blog", "shop", "archive"),
    "de": ("startseite", "nachrichten", "kontakt", "suche", "hilfe", "archiv", "menü", "über uns"),
    "fr": ("accueil", "actualités", "recherche", "aide", "archives", "boutique", "à propos"),
    "es": ("inicio", "noticias", "contacto", "buscar", "ayuda", "archivo", "tienda", "acerca de"),
}
LEAST_MENU = 3

_has_mark = re.compile(f"[{SENTENCE_MARKS}]").search
_ascii_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_codes = np.random.default_rng(8).integers(1, 1 << 62, WINDOW, np.int64).astype(np.uint64) | np.uint64(1)


def _spaced(words: list[str]) -> str:
    """Each word between two spaces of its own, so that neighbouring phrases are both found."""
    return "".join(f" {w} " for w in words)


def _phrases(by_language: dict[str, tuple[str, ...]]) -> dict[str, int]:
    """Each different phrase, spaced, and its number of words."""
    return {_spaced(p.split()): len(p.split()) for phrases in by_language.values() for p in phrases}


_notices, _calls, _menu = map(_phrases, (NOTICES, CALLS, MENU))
#: The longest word of every phrase; where none of them stands there is no phrase.
KEYS = tuple(sorted({max(p.split(), key=len) for p in (*_notices, *_calls, *_menu)}))


def keys_in(text: str) -> tuple[str, ...]:
    """The keys that a text holds: its lines need not be searched for others."""
    low = text.lower()  # quicker than A-Z alone, and letters of the keys stay as they are
    return tuple(k for k in KEYS if k in low)


def is_boilerplate(words: list[str]) -> bool:
    """Whether a line of these words is a notice, a call or a menu."""
    line = _spaced([w.translate(_ascii_lower).strip(EDGES) for w in words])
    if any(p in line for p in _notices):
        return True
    calls, entries = (sum(line.count(p) * k for p, k in kind.items()) for kind in (_calls, _menu))
    return 0 < len(words) <= LEAST_CALLS * calls or (entries >= LEAST_MENU and 2 * entries >= len(words))


def line_fails(line: str, words: list[str], keys: tuple[str, ...] = KEYS) -> bool:
    """Whether a line with words breaks one of the rules for lines; ``keys`` are those that it may hold."""
    n = len(words)
    if n >= LEAST_SENTENCE and not _has_mark(line):
        return True
    if 2 * sum(map(line.count, SYMBOLS)) >= n:
        return True
    if n >= LEAST_SENTENCE and line.count("!") >= n:
        return True
    if 4 * (bars := sum(map(words.count, SEPARATORS))) >= n and bars >= 2:
        return True
    if not keys:
        return False
    low = line.lower()
    return any(k in low for k in keys) and is_boilerplate(words)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # Equal windows have equal sums; without equal sums nothing repeats.
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    sums = np.zeros(n, np.uint64)
    for i in range(window):
        sums += hashes[i : i + n] * _codes[i]
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Exact numbers of windows of 1, 2, 4 … words; two equal numbers mean equal words.
    numbers: dict[str, int] = {}
    same = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    span = 1
    while span < window:
        step = min(span, window - span)
        left, right = same[: len(same) - step], same[step:]
        same = np.unique(left * (int(same.max()) + 1) + right, return_inverse=True)[1]
        span += step
    again = np.bincount(same)[same] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int(np.count_nonzero(np.cumsum(edges)))


def judge(text: str) -> tuple:
    """Counts of a text, both verdicts, and the text without its failing lines."""
    words = find_words(text)
    seen: set[str] = set()
    duplicate = lost = failed = 0
    keep: list[str] = []
    keys = keys_in(text)
    for line in text.split("\n"):
        own = find_words(line)
        if own:
            if line in seen:
                duplicate += 1
            else:
                seen.add(line)
            if line_fails(line, own, keys):
                lost += len(own)
                failed += 1
                continue
        keep.append(line)
    n, repeated = len(words), repeated_words(words)
    bad = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    kept = not bad and 100 * lost <= MOST_LOST * n
    counts = (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate, repeated, failed, lost)
    return *counts, bad, kept, "\n".join(keep) if failed else text


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "n_lost_words")


def assess(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, the counts, ``base_failed``, ``kept`` and ``clean_text`` of every document."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, *COUNTS, "base_failed", "kept", "clean_text"]

    def run(batches):
        for batch in slices(batches):
            judged = list(zip(*map(judge, texts_of(batch, text_column))))
            arrays = [pa.array(v, pa.int64()) for v in judged[: len(COUNTS)]]
            arrays += [pa.array(judged[-3], pa.bool_()), pa.array(judged[-2], pa.bool_()), pa.array(judged[-1], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(id_column, text_column).mapInArrow(
        run, f"`{id_column}` {kind}, {counts}, base_failed boolean, kept boolean, clean_text string"
    )


def clean(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass, all columns, with failing lines removed from the text.

    Works row by row in place: nothing is joined back, so repeated and null ids are safe.
    ``n_chars``, where there is such a column, counts the text that is left.
    """
    schema = docs.schema
    at = schema.fieldNames().index(text_column)
    counted = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches):
        for batch in slices(batches):
            judged = [judge(t) for t in texts_of(batch, text_column)]
            rows = pa.array([i for i, j in enumerate(judged) if j[-2]], pa.int64())
            left = batch.take(rows)
            texts = [judged[i][-1] for i in rows.to_pylist()]
            columns = list(left.columns)
            columns[at] = pa.array(texts, left.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array(map(len, texts), pa.int64()).cast(left.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=left.schema)

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    return assess(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql_text(text: str) -> str:
    return text.replace("'", "''")


def oracle_sql() -> str:
    """The same counts and verdicts in DuckDB."""
    word = "[^ \\x09-\\x0D]+"
    marks = "strlen(regexp_replace(line, '[^{0}]', '', 'g'))"
    bars = " + ".join(f"len(list_filter(lw, lambda x: x = '{s}'))" for s in SEPARATORS)
    count = lambda kind: " + ".join(
        f"{k} * ((length(low) - length(replace(low, '{_sql_text(p)}', ''))) // {len(p)})" for p, k in kind.items()
    )
    phrases = " OR ".join(f"contains(low, '{_sql_text(p)}')" for p in _notices)
    phrases += f" OR (len(lw) <= {LEAST_CALLS} * ({count(_calls)}))"
    phrases += f" OR (({count(_menu)}) >= greatest({LEAST_MENU}, len(lw) / 2))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{word}') AS w
  FROM documents),
lines AS (
  SELECT r, line, lw, array_to_string(list_transform(lw, lambda x:
           ' ' || trim(translate(x, '{upper}', '{lower}'), '{_sql_text(EDGES)}') || ' '), '') AS low
  FROM (SELECT r, line, regexp_extract_all(line, '{word}') AS lw
        FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d))),
rules AS (
  SELECT r, line, len(lw) AS n,
         (len(lw) >= {LEAST_SENTENCE} AND NOT regexp_matches(line, '[{SENTENCE_MARKS}]'))
         OR 2 * {marks.format(SYMBOLS)} >= len(lw)
         OR (len(lw) >= {LEAST_SENTENCE} AND {marks.format("!")} >= len(lw))
         OR (4 * ({bars}) >= len(lw) AND ({bars}) >= 2)
         OR {phrases} AS bad
  FROM lines WHERE len(lw) > 0),
by_doc AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup,
         count(*) FILTER (WHERE bad) AS failed, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost
  FROM rules GROUP BY r),
windows AS (
  SELECT r, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS p FROM d WHERE len(w) > {WINDOW})),
twice AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) AS n
  FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM twice) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         strlen(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(failed, 0) AS n_failed_lines, coalesce(lost, 0) AS n_lost_words
  FROM d LEFT JOIN by_doc USING (r) LEFT JOIN covered USING (r)),
verdict AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counts)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS)}, base_failed,
       NOT base_failed AND 100 * n_lost_words <= {MOST_LOST} * n_words AS kept
FROM verdict"""
