"""The corpus operators' queries and their SQL twins, by name."""

from cairn.llm import ann, bpe, hosts, language, lines, lm, mixing, quality, secrets, simhash

QUERIES = {
    "op1_mih": ann.op1_mih,
    "op2_quality": quality.op2_quality,
    "op3_url_filter": hosts.op3_url_filter,
    "op4_language": language.op4_language,
    "op5_bpe": bpe.op5_bpe,
    "op6_lines": lines.op6_lines,
    "op7_secrets": secrets.op7_secrets,
    "op8_lm": lm.op8_lm,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op3_url_filter": hosts.ORACLE, "op6_lines": lines.ORACLE, "op10_mixing": mixing.ORACLE}
