"""The operators' queries and, where SQL can express them, their DuckDB equivalents; the pipeline's are in its own module."""

from __future__ import annotations

from collections.abc import Callable

from kinelake.llm import bpe, chat_tree, dual_tree, langid, mixing, mtree, nb_svm, pii, simhash, suffix_dedup, transport, url_filter, whitening


def queries() -> dict[str, Callable]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_chat_tree": chat_tree.op2_chat_tree,
        "op3_simhash": simhash.op3_simhash,
        "op4_pii": pii.op4_pii,
        "op5_mixing": mixing.op5_mixing,
        "op6_bpe": bpe.op6_bpe,
        "op7_mtree": mtree.op7_mtree,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_transport": transport.op9_transport,
        "op10_langid": langid.op10_langid,
        "op11_nb_svm": nb_svm.op11_nb_svm,
        "op12_whitening": whitening.op12_whitening,
        "op13_dual_tree": dual_tree.op13_dual_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_tree": chat_tree.ORACLE,
        "op4_pii": pii.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "op7_mtree": mtree.ORACLE,
        "op8_suffix_dedup": suffix_dedup.ORACLE,
        "op13_dual_tree": dual_tree.ORACLE,
    }
