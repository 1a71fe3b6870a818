"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, html_text, licenses, near_duplicates, packing, quality, sharding, telephony, toxicity, warc


def queries() -> dict:
    return {
        "op1_fourier_quality": quality.op1,
        "op2_license_scan": licenses.op2,
        "op3_retrieval_packing": packing.op3,
        "op4_hypergeometric_shards": sharding.op4,
        "op5_site_templates": html_text.op5,
        "op6_probminhash_near_duplicates": near_duplicates.op6,
        "op7_warc": warc.op7,
        "op8_boosted_toxicity": toxicity.op8,
        "op9_telephony_audio": telephony.op9,
        "op10_winnowing_decontamination": decontamination.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc": warc.ORACLE,
        "op10_winnowing_decontamination": decontamination.ORACLE,
    }
