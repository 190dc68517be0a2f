"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import chat, decontamination, fingerprints, jaccard_join, kneser_ney, licenses, mixing, separators, sstable, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_counts": separators.op3_token_counts,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_licenses": licenses.op5_licenses,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_lm_score": kneser_ney.op7_lm_score,
    "op8_token_output": sstable.op8_token_output,
    "op9_chat_format": chat.op9_chat_format,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op4_decontamination": decontamination.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op7_lm_score": kneser_ney.OP7_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
