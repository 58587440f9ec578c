"""Defaults and fixed values.

``Defaults`` holds the limits that act as semantics; every operator takes them as parameters.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    chunk_size: int = 1500
    chunk_overlap: int = 200
    top_k: int = 6
    service_top_k: int = 5
    min_score: float = 17.0
    dedup_prefix: int = 300
    graph_limit: int = 20
    graph_batch: int = 8
    keyword_chars: int = 1500
    graph_chars: int = 2000
    history_messages: int = 5
    history_chars: int = 2500
    recent_messages: int = 6
    recent_chars: int = 200
    ttl_days: int = 7
    encode_batch_query: int = 32
    encode_batch_document: int = 128


DEFAULTS = Defaults()

# --- Fixed values: output formats that must agree character by character for equal results. ---
PAGE_MARKER = r"\n--- Page (\d+) ---\n"
CHUNK_HEADER_DOCUMENT = "문서"
CHUNK_HEADER_PAGE = "페이지"
CHUNK_HEADER_KEYWORDS = "키워드"
ATTACHMENT_SCHEME = "ATTACH://"
ATTACHMENT_LABEL = "첨부파일"
DATE_RULE = "====="
ROLE_LABEL_USER = "사용자"
ROLE_LABEL_OTHER = "AI"
NO_EVIDENCE_SUFFIX = "에 대한 관련 문서를 찾지 못했습니다."
NO_ANSWERS = "관련 정보를 찾지 못했습니다."
ANSWER_HEADING = "### 답변 "
UNSUPPORTED_DOCUMENT = "지원되지 않는 JSON 형식이거나 빈 문서입니다."
END_MARK = "끝."
LAST_ITEM_SUFFIX = "  끝."
UNKNOWN_SOURCE = "unknown"
SPREADSHEET_TITLE = "Spreadsheet"
PDF_TITLE = "PDF Document"
DECK_TITLE = "Presentation"
LINE_PARAGRAPH_OPEN = (
    '<hp:p id="2147483648" paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="9"><hp:t>'
)
LINE_PARAGRAPH_CLOSE = (
    '</hp:t></hp:run><hp:linesegarray><hp:lineseg textpos="0" vertpos="0" vertsize="1200"'
    ' textheight="1200" baseline="1020" spacing="720" horzpos="0" horzsize="49608"'
    ' flags="393216"/></hp:linesegarray></hp:p>'
)
ITEM_PARAGRAPH_CLOSE = "</hp:t></hp:run></hp:p>"
LINE_PARAGRAPH_TAG = "<hp:p "
ITEM_PARAGRAPH_TAG = "<hp:p"
PARAGRAPH_END_TAG = "</hp:p>"
# (paragraph property id, style id) of a level-1 item and of any other item
ITEM_STYLE_TOP = ("28", "2")
ITEM_STYLE_NESTED = ("29", "1")
# white space as str.strip() sees it
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# --- End of fixed values. ---

# Own wording; every prompt is a parameter of the operator that uses it.
PROMPT_PLAIN = (
    "Answer the question using only the passages below and name the file and page of each fact.\n\n"
    "Question:\n{question}\n\nPassages:\n{context}"
)
PROMPT_CROSS = (
    "Answer the question from two kinds of evidence. Prefer the passages where they disagree.\n\n"
    "Passages:\n{context}\n\nRelations:\n{graph}\n\nQuestion:\n{question}"
)
PROMPT_NO_PASSAGES = "(no passages)"
PROMPT_MERGE = "Merge the answers below into one answer to: {question}\n{answers}"
PROMPT_RECALL = "Summarise this conversation in a few sentences, for someone who answers its next question:\n{conversation}"
PROMPT_ANALYZE = (
    "Decide whether the question can be answered as it stands, and rewrite it as one or more questions that need no conversation. Reply"
    " with JSON: is_clear, rewritten_questions, clarification_message.\n\nConversation so far:\n{summary}\n\nQuestion:\n{question}"
)
PROMPT_CLARIFY = "Please state your question more precisely."
CHAT_SYSTEM = "You are a careful assistant. Rely on the supplied reference material."
CHAT_WITH_CONTEXT = (
    "Question:\n{question}\n\nReference material:\n{context}\n\n"
    "Use the material; say so if it does not cover the question.\n\nQuestion:\n{question}"
)
CHAT_WITHOUT_CONTEXT = (
    "Question:\n{question}\n\nNo reference material was found. Do not invent facts.\n\n"
    "Question:\n{question}"
)
SUMMARY_SYSTEM = "You summarise phone calls. Report only what was said."
SUMMARY_FORMAT = "Give: participants, one-line summary, topics in order, agreed actions, tags."
SUMMARY_EXTRA_HEADING = "[Additional instructions]"
SUMMARY_LEAD_IN = "Summarise this call:"
