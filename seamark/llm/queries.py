"""Queries of the text problems p3, p7, p8, p9, p10, and their SQL where SQL can state them."""

from __future__ import annotations

from seamark.functions.page_key import page_key_sql
from seamark.llm import merkle, mixing, packing, residue, subjects
from seamark.session import table


def p3_found(spark, d):
    pages = table(spark, d, "page_audit")
    return residue.residue_pages(pages).select("page_id").distinct()


def p3_clean(spark, d):
    pages = table(spark, d, "page_audit")
    found = residue.residue_pages(pages).select("page_id").distinct()
    good = pages.filter("status_code BETWEEN 200 AND 299").select("page_id", "crawl_id", "url", "title", "word_count")
    return good.join(found, "page_id", "left_anti")


def p3_validation(spark, d):
    """Figures on the weak labels of hosts that the classifier was not fitted on."""
    kinds = residue.piece_table(table(spark, d, "page_audit"))
    figures = residue.validate(kinds, residue.train(kinds))
    return spark.createDataFrame([(k, float(v)) for k, v in figures.items()], "measure string, value double")


def p7_found(spark, d):
    return merkle.page_copies(table(spark, d, "page_audit"))


def p7_classes(spark, d):
    return merkle.page_classes(table(spark, d, "page_audit"))


def p7_texts(spark, d):
    return merkle.text_classes(table(spark, d, "documents"))


def p8_pack(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_report(spark, d):
    limits = table(spark, d, "pack_limits")
    return packing.fill_report(packing.pack(table(spark, d, "documents"), limits), limits)


def p9_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_shares(spark, d):
    targets = table(spark, d, "source_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def _assigned(spark, d):
    return subjects.assign(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p10_found(spark, d):
    return _assigned(spark, d).select("doc_id", "subject").distinct()


def p10_shares(spark, d):
    return subjects.corpus_shares(_assigned(spark, d), table(spark, d, "documents"))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p3_found": p3_found, "p3_clean": p3_clean, "p3_validation": p3_validation, "p7_found": p7_found, "p7_classes": p7_classes, "p7_texts": p7_texts, "p8_pack": p8_pack, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares}

_HOST = "regexp_extract(url_key, '^[^/?]*')"
_KEYED = f"SELECT *, {page_key_sql('canonical', _HOST)} AS canonical_key FROM (SELECT *, {page_key_sql('url')} AS url_key FROM page_audit)"
_SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# what counts of the punctuation of numbers, as private letters
_NUMBERS = "text"
for _i, _c in enumerate("-.,:/"):
    _NUMBERS = f"regexp_replace({_NUMBERS}, '[{_c}]([0-9])', chr({0xE000 + _i}) || '\\1', 'g')"
_NUMBERS = f"regexp_replace({_NUMBERS}, '([0-9])%', '\\1' || chr({0xE010}), 'g')"

ORACLES = {
    "p7_found": f"""
        SELECT keep_id, page_id FROM (SELECT page_id, min(page_id) OVER (PARTITION BY crawl_id, url_key, canonical_key) AS keep_id FROM ({_KEYED})) WHERE page_id <> keep_id""",
    "p7_classes": f"""
        SELECT min(page_id) AS keep_id, crawl_id, url_key, canonical_key, count(*) AS copies FROM ({_KEYED}) GROUP BY crawl_id, url_key, canonical_key""",
    "p7_texts": rf"""
        SELECT min(doc_id) AS keep_id, count(*) AS copies FROM documents
        GROUP BY lower(trim(regexp_replace(regexp_replace({_NUMBERS}, '\p{{P}}', ' ', 'g'), '[{_SPACE}]+', ' ', 'g')))""",
}
