"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from isomesh.llm import audit, langid, licences, middle, near, order, packing, pieces, pii, quality, secrets, sitestyle, toxic
from isomesh.llm.work import table

QUERIES = {
    "op1_language_id": lambda spark, sf_dir: langid.report(table(spark, sf_dir, "documents")),
    "language_id_pages": lambda spark, sf_dir: langid.report_pages(table(spark, sf_dir, "pages")),
    "op2_site_style": lambda spark, sf_dir: sitestyle.report(table(spark, sf_dir, "pages")),
    "op3_order_minhash": lambda spark, sf_dir: order.report(table(spark, sf_dir, "documents")),
    "op4_secret_links": lambda spark, sf_dir: secrets.report(table(spark, sf_dir, "documents")),
    "op5_subsequence_svm": lambda spark, sf_dir: toxic.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_vector_packing": lambda spark, sf_dir: packing.report(table(spark, sf_dir, "documents")),
    "vector_packing_turns": lambda spark, sf_dir: packing.report_turns(table(spark, sf_dir, "conversations")),
    "op7_perplexity": lambda spark, sf_dir: quality.report(table(spark, sf_dir, "documents")),
    "op8_piece_lattice": lambda spark, sf_dir: pieces.encode(table(spark, sf_dir, "documents")),
    "op9_bag_minhash": lambda spark, sf_dir: near.report(table(spark, sf_dir, "documents")),
    "op10_pii": lambda spark, sf_dir: pii.report(table(spark, sf_dir, "documents")),
    "op11_filter_audit": lambda spark, sf_dir: audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_license_scan": lambda spark, sf_dir: licences.report(table(spark, sf_dir, "documents")),
    "op13_fill_in_middle": lambda spark, sf_dir: middle.report(table(spark, sf_dir, "documents")),
}

ORACLE_SQL: dict[str, str] = {"op11_filter_audit": audit.SQL, "op13_fill_in_middle": middle.SQL}
