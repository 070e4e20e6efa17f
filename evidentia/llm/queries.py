"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from . import alignment, collocations, decontamination, exact_dedup, licenses, packing, quality, repeats, simhash, surrogates, token_counts, toxicity, warc

MODULES = {
    "op1_packing": packing,
    "op2_surrogates": surrogates,
    "op3_token_counts": token_counts,
    "op4_toxicity": toxicity,
    "op5_exact_dedup": exact_dedup,
    "op6_warc": warc,
    "op7_repeats": repeats,
    "op8_quality": quality,
    "op9_simhash": simhash,
    "op10_decontamination": decontamination,
    "op11_licenses": licenses,
    "op12_collocations": collocations,
    "op13_alignment": alignment,
}

QUERIES = {name: module.query for name, module in MODULES.items()}
SQL = {name: module.SQL for name, module in MODULES.items() if module.SQL}
