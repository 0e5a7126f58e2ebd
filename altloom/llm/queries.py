"""The registered queries of this package and the SQL of those that SQL can express."""

from altloom.llm import archive, bpe, collocations, exact, langid, licenses, mixing, pii, quality, search, sharding, simhash, token_files

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_token_files": token_files.op5_token_files,
    "op6_simhash": simhash.op6_simhash,
    "op7_language": langid.op7_language,
    "op8_archive": archive.op8_archive,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_shards": sharding.op10_shards,
    "op11_collocations": collocations.op11_collocations,
    "op12_search": search.op12_search,
    "op13_pii": pii.op13_pii,
}
CHECKS = {
    "op1_mix": mixing.OP1_SQL,
    "op2_license_scan": licenses.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op8_archive": archive.OP8_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_search": search.OP12_SQL,
}
