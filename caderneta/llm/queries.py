"""All checkable queries of the corpus operators: importing this module registers them."""

from caderneta.llm import (  # noqa: F401
    q_content_sort,
    q_conversation_repair,
    q_filter_audit,
    q_hilbert,
    q_imatch,
    q_language_id,
    q_line_quality,
    q_merge_dropout,
    q_packing,
    q_page_text,
    q_pipeline,
    q_simhash,
    q_surrogates,
    q_url_filter,
)
from caderneta.llm.registry import PLANS, SQL  # noqa: F401
