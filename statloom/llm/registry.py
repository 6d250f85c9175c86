"""Queries of the operators for training data, by number, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from statloom.llm.bagminhash import op4_bagminhash
from statloom.llm.chroma import op7_chroma
from statloom.llm.dac import op9_dac
from statloom.llm.exact import OP12_SQL, op12_polynomial
from statloom.llm.fim import OP13_SQL, op13_fim
from statloom.llm.langid import op2_ppm
from statloom.llm.lines import op3_simhash_lines
from statloom.llm.merkle import OP11_SQL, op11_merkle
from statloom.llm.packing import op6_packing
from statloom.llm.suffix import op10_suffix
from statloom.llm.toxicity import op5_toxicity
from statloom.llm.warc import OP1_SQL, op1_warc
from statloom.llm.winnow import OP8_SQL, op8_winnowing


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_ppm": op2_ppm,
        "op3_simhash_lines": op3_simhash_lines,
        "op4_bagminhash": op4_bagminhash,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_chroma": op7_chroma,
        "op8_winnowing": op8_winnowing,
        "op9_dac": op9_dac,
        "op10_suffix": op10_suffix,
        "op11_merkle": op11_merkle,
        "op12_polynomial": op12_polynomial,
        "op13_fim": op13_fim,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op1_warc": OP1_SQL, "op8_winnowing": OP8_SQL, "op11_merkle": OP11_SQL, "op12_polynomial": OP12_SQL, "op13_fim": OP13_SQL}
