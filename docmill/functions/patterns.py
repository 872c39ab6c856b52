"""Patterns and word lists shared by the operators."""

# Patterns that decide which text is a heading, a table row, a number, a date or a reference.
HEADING = r"^(#{1,6})(?U:\s)+(.+?)(?U:\s)*$"
TABLE_ROW = r"^(?U:\s)*\|(.+)\|(?U:\s)*$"
NUMBER = r"(?<![0-9A-Za-z./年月日-])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![0-9A-Za-z./年月日-])"
DATE = r"(?:20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:日)?)|(?:\d{1,2}[-/.]\d{1,2}[-/.]20\d{2})"
REFERENCE = (
    r"(见|参见|详见|参考|如|同|延续|承接)(?U:\s)*"
    r"(?:第(?U:\s)*(\d{1,4})(?U:\s)*页|上文|前述|上述|同上|上一节|下表|上表|附件(?U:\s)*([A-Za-z0-9一二三四五六七八九十]+))"
)
LIST_PREFIX = r"^(?U:\s)*(?:[-*•]|\d+[.)、]|[（(]?\d+[)）])(?U:\s)*"
GARBLED = r"(?:�|锟斤拷|Ã.|Â.)"
LOW_VALUE_SECTION = (
    r"(?i)^(?U:\s)*(contents|table of contents|list of figures|list of tables|revision history|document history|change history)(?U:\s)*$"
)
HTML_TABLE = r"(?is)<table\b.*?</table>"

# Words by which lines and keys are recognised.
RECOMMENDATION_WORDS = ("建议", "处理建议", "整改", "措施", "action", "recommend")
ANOMALY_WORDS = ("异常", "风险", "问题", "复核", "告警", "缺陷", "error", "warning", "risk", "issue")
TOTAL_WORDS = ("合计", "总计", "小计", "total", "subtotal")
ENTITY_WORDS = ("公司", "甲方", "乙方", "party", "company", "issuer")
KEY_HEADERS = ("key", "field", "name", "字段", "项目", "科目", "条款", "指标")
VALUE_HEADERS = ("value", "amount", "status", "description", "值", "数值", "金额", "状态", "说明", "内容")

# White space as strip() takes it, and what ends a line as splitlines() sees it.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
