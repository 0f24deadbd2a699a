"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from corpuslens.llm import fingerprints, mixing, negatives, packing, partenum, phrases, pieces, pii, quality, rules, secrets, sharding, sql, warc

QUERIES = {
    "op1_best_two_fit": packing.op1_best_two_fit,
    "op2_fourier_ridge": quality.op2_fourier_ridge,
    "op3_nbest_pieces": pieces.op3_nbest_pieces,
    "op4_prefix_hashes": fingerprints.op4_prefix_hashes,
    "op5_revisits": warc.op5_revisits,
    "op6_external_shuffle": sharding.op6_external_shuffle,
    "op7_line_frequency": rules.op7_line_frequency,
    "op8_private_terms": pii.op8_private_terms,
    "op9_secret_ledger": secrets.op9_secret_ledger,
    "op10_partenum": partenum.op10_partenum,
    "op11_fair_queue": mixing.op11_fair_queue,
    "op12_trie_phrases": phrases.op12_trie_phrases,
    "op13_one_bit_negatives": negatives.op13_one_bit_negatives,
}

SQL: dict[str, str] = {
    "op5_revisits": sql.REVISITS,
    "op7_line_frequency": sql.RULES,
    "op8_private_terms": sql.PRIVATE,
    "op9_secret_ledger": sql.SECRETS,
    "op10_partenum": sql.NEAR,
    "op11_fair_queue": sql.MIX,
    "op12_trie_phrases": sql.PHRASES,
    "op13_one_bit_negatives": sql.NEGATIVES,
}
