"""Fixed values of information extraction and summaries: they must be these for right results."""

from __future__ import annotations

# ---- fixed values ---------------------------------------------------------------------------

CHAIR, EVERYONE = "Người chủ trì", "Mọi người"
UNSURE = "Chưa rõ"
NOTHING = "Không có"

ACTION_VERBS = (
    "làm", "update", "sửa", "fix", "viết", "gửi", "upload", "cập nhật", "phụ trách", "chạy",
    "test", "thiết kế", "hoàn thành", "nộp", "điều", "xong", "hỗ trợ", "nhớ", "thực hiện",
)
EXTRA_VERBS = ("tổng hợp", "đối chiếu", "rà soát", "chuẩn bị", "liên hệ", "chỉnh")
DOER_VERBS = ("nhận", "lập", "xếp", "lo", "gom", "rà")
NOT_AFTER_DOER_VERB = ("thấy", "ra", "xét", "định", "thức", "diện", "được", "lắng", "ngại", "sợ", "âu")
FUNCTION_WORDS = (
    "nào", "nữa", "bên", "trước", "sau", "là", "sẽ", "phải", "làm", "gửi", "có", "cần", "ơi", "ấy", "kia", "đó", "tuần", "tháng",
    "mình", "mọi", "ai", "này", "nơi", "tiếp", "còn", "về", "đầu", "nếu", "vậy", "hôm", "ok",
    "thì", "mà", "nên", "rồi", "theo", "khi", "vì", "để", "và", "cũng", "thầy",
)
ASSIGNMENT_SIGNALS = ("giao cho", "phụ trách", "sẽ", "phải", "cần")

# deadlines
_WEEKDAY = r"thứ\s+(?:\d+|hai|ba|tư|bốn|năm|sáu|bảy)\b(?:\s+tuần\s+(?:này|sau|tới))?"
_SUNDAY = r"chủ\s+nhật(?:\s+tuần\s+(?:này|sau|tới))?"
_DAY_MONTH = r"(?:ngày\s+)?\d{1,2}\s+tháng\s+\d{1,2}|\d{1,2}/\d{1,2}(?:/\d{2,4})?"
_OTHER_DAY = (
    r"hôm\s+nay|ngày\s+mai|ngày\s+kia|cuối\s+tuần(?:\s+này)?|cuối\s+tháng(?:\s+này)?|tuần\s+(?:này|sau|tới)|tháng\s+(?:này|sau|tới)"
)
DATE = rf"\b(?:{_WEEKDAY}|{_SUNDAY}|{_DAY_MONTH}|{_OTHER_DAY})(?!\w)(?!\s+(?:tuần|tháng)\s+trước)"
NAMED_DEADLINE = r"\b(?:deadline|hạn\s+chót|chậm\s+nhất|hạn)\b[^,.:;?!]{0,40}?(?:\blà\b|:)\s*(?P<value>[^,.;?!]+)"
OLD_DEADLINE = r"\b(?:ban\s+đầu|lúc\s+đầu|hạn\s+cũ|hạn\s+(?:chót\s+)?dự\s+kiến)\b"
PAST_BEFORE_DATE = r"(?:tuần|tháng|hôm|ngày)\s+trước\s*$"
DENIED_BEFORE_DATE = r"(?:không|đừng)\s+(?:để\s+)?(?:đến|vào|trước)?\s*$"
DEADLINE_PREFIX = r"(?:trước|chậm\s+nhất|vào|đến|xong)\s*$"
DEADLINE_TAIL = r"\s+(?:luôn|nhé|nha|nữa|thôi|ạ)$"
SMALL_TALK_TAIL = r"(?:,\s*)?(?:còn\s+)?(?:ai\s+có\s+ý\s+kiến\s+gì\s+không\?|có\s+ai\s+.*\bý\s+kiến\b.*\?|cảm\s+ơn.*)$"
POINTING_START = r"^(?:đó\s+là|đây\s+là)\s*"
NOT_A_DEADLINE = r"\b(?:điều này|ý kiến|có ai|đến|gặp|lúc)\b"
EMPTY_DEADLINES = ("là", "đây", "đó")
ORDINAL_START = r"^thứ\s+\d+\s+là\b"

# names
TITLES = ("bạn", "anh", "chị", "em", "cô", "chú")
TITLE = r"(?:bạn|anh|chị|em|cô|chú)"
LETTERS = "A-ZÀ-Ỹa-zà-ỹ"
COMPANY = r"\bcông ty\s+[A-ZÀ-Ỹa-zà-ỹ]+(?:\s+[A-ZÀ-Ỹa-zà-ỹ]+)?"
AFTER_CAPITAL_NAME = r"(?:bên|làm|sẽ|phải|nên|cần|nhớ|gửi|viết|cập nhật|update|fix|sửa|upload|phụ trách|xong|chạy|theo|test|thiết kế)"
NOT_A_FAMILY_NAME = (
    "phần", "mục", "việc", "tôi", "thứ", "ngày", "dạ", "chốt", "hai", "ba", "tư", "năm", "sáu", "bảy", "nhật",
    "sáng", "trưa", "chiều", "tối", "đêm", "giờ", "lúc", "hiện", "tạm", "sớm", "nhưng", "với", "cho", "các", "những",
    "cả", "tất", "thế", "ừ", "còn", "và", "rồi", "vậy", "thì", "nếu", "ok", "để", "về", "đã", "này", "hôm", "tuần", "tháng",
    "mình", "em", "anh", "chị", "bạn", "cô", "chú", "thầy",
)
NEVER_A_NAME = (
    "mình", "tôi", "em", "anh", "chị", "bạn", "mọi người", "người chủ trì", "để", "ok", "nếu", "còn", "về", "đầu", "tiếp",
    "xong", "phụ trách", "làm", "đã", "trước", "thứ", "hôm", "này",
)
PRONOUNS = ("mình", "tôi", "em", "anh", "chị", "bạn")
BEFORE_RECEIVER = r"(?:giao\s+cho|chuyển\s+(?:sang\s+)?cho|nhờ|phụ\s+trách)\s+$"
AFTER_LOWER_NAME = r"^\s+(?:bên\s+\w+(?:\s+\w+)?\s+)?(?:sẽ|phải|nên|cần|nhớ|cố\s+gắng|đang|{verbs})\b"
EVERYONE_ACTS = r"\bmọi người\b.*\b(làm|nộp|upload|gửi|viết|cập nhật|chạy|ghi|xong)\b"
NAME_ACTS = (
    r"(?:sẽ|phải|nên|làm|gửi|viết|update|fix|sửa|upload|cập nhật|phụ trách|nhớ|chạy|xong|test|cố gắng|hoàn thành|nộp|thiết kế|thực hiện|hỗ trợ)\b"
)
HANDED_TO = r"\b(?i:giao\s+cho|phụ\s+trách)\s+"
SHALL = r"\s+(?i:sẽ|phải|nên)\b"
DOES = r"\s+(?i:làm|viết|gửi|upload|update|fix|sửa|cập nhật|phụ trách|chạy|test)\b"
TITLED_DOES = r"\b.*(?i:sẽ|phải|nên|làm|viết|gửi|update|fix|sửa|upload|cập nhật|chạy|test)\b"
SELF_ACTS = r"\b(mình|tôi|em)\b.*\b(làm|sẽ|gửi|viết|update|fix|upload|cập nhật|xong)\b"

# tasks
BEFORE_DOER = r"(?:sẽ|phải|cần|nên|nhớ|giúp|tự|cũng|rồi|đó|thì|để|mình|tôi|em|anh|chị|bạn)"
BETWEEN_DOER = r"(?:(?:cũng|tự|đang|sẽ)\s+)*"
CLAUSE_OPENER = r"^(?:mình|tôi|em|việc\s+này|còn|thứ(?:\s+\d+)?|phần(?:\s+này)?|bên)\b\s*"
OWNER_AT_END = (
    r"(?:giao\s+cho\s+(?:(?:bạn|anh|chị|em|cô|chú)\s+)?[a-zà-ỹ]+(?:\s+[a-zà-ỹ]+)?(?:\s+phụ\s+trách)?"
    r"|[a-zà-ỹ]+(?:\s+[a-zà-ỹ]+)?\s+phụ\s+trách|để\s+(?:mình|tôi|em)\s+làm)\s*[,.;:!?]*$"
)
OBJECT_THEN_DO = r"^(?P<head>.+?)\s+(?:thì\s+)?(?:tự\s+)?(?:làm|phụ\s+trách)\s*[,;:.!?]*$"
OBJECT_THEN_DUTY = r"^(?P<head>.+?)\s+phụ\s+trách\s+(?P<tail>\S.*)$"
OBJECT_OPENER = r"^(?:(?:thì|còn|về|riêng|việc)\s+)+"
SELF_SUBJECT = r"(?<!\bcho\s)(?<!\bvới\s)(?<!\bgiúp\s)(?<!\bnhờ\s)(?<!\bbảo\s)\b(?:mình|tôi|em)\s+(?:sẽ\s+|tự\s+)?\S"
BARE_VERB = (
    r"^(?:(?:mình|tôi|em)\s+)?(?:(?:sẽ|tự|cũng|rồi|sau\s+đó)\s+)*"
    r"(?P<verb>(?:rà\s+soát|kiểm\s+tra|review|check|test|hoàn\s+thiện|xử\s+lý|làm|sửa|viết|chạy|gửi|nộp|cập\s+nhật|update|fix|thiết\s+kế)"
    r"(?:\s+(?:lại|kỹ|xong|luôn|nốt))?)\s*[,;:.!?]*$"
)
THINKS = r"(?:thấy|nghĩ|biết|hiểu|muốn|có\s+thể|có\s+ý\s+kiến)"
LIGHT_VERB_START = r"^(?:lo(?!\s+(?:lắng|ngại|sợ|âu))|nhận(?=\s+(?:phần|việc|mục|giúp|nhiệm\s+vụ)\b))\s+"
HEADING_STARTS = (r"^(đầu tiên|tiếp theo|cuối cùng|tiếp theo đó)\s+là\b", r"^thứ\s+\d+\s+là\b")
PART_START = r"^(?:phần|mục)\s+.*$"
CONNECTIVE_START = r"^(?:vì vậy|do đó|ngoài ra|tuy nhiên|nhưng|nên|còn)\b\s*,?\s*"
ACTION_FRAGMENT = r"(?:để|phụ trách|làm|xong)\s*[,.;]?\s*"
STATE_NOT_ACTION = (r"\b(?:chưa|đã|vừa|mới|chẳng)\s+xong\b", r"\blàm\s+việc\s+với\b")
ACTS = r"\b(?:làm|update|sửa|fix|viết|gửi|upload|cập nhật|phụ trách|chạy|test|thiết kế|hoàn thành|nộp|xong|hỗ trợ|thực hiện|điều|cố gắng)\b"
NAMED_SIGNAL = r"\s+(?:sẽ|cần|nhớ)\s+(?!(?:là|có|được|bị|đi|gặp|ở)\b)\S+"
STRONG_SIGNAL = r"(?<!không\s)(?<!chưa\s)\b(?:sẽ|phải|nhớ|phụ\s+trách|giao\s+cho)\b"
PAST = (
    r"^(?:(?:mà|còn|nhưng|và)\s+)?(?:hôm\s+qua|hôm\s+trước|bữa\s+trước|bữa\s+nọ|(?:tuần|tháng|buổi)\s+trước|(?:tuần|tháng)\s+rồi|lúc\s+nãy|hồi\s+nãy|vừa\s+rồi)\b"
    r"|\b(?:hôm\s+qua|hôm\s+trước|bữa\s+trước|tuần\s+trước|tuần\s+rồi|lúc\s+nãy|hồi\s+nãy)\s+thì\b"
)
FORBIDDEN = r"\b(?:đừng(?!\s+quên)|không\s+cần|khỏi\s+phải|chưa\s+cần)\b"
GUESS = r"^(?:(?:mà|còn|nhưng|và)\s+)?(?:có\s+thể|có\s+lẽ|hình\s+như|chắc\b(?!\s+chắn))"
REPORTED = r"\b(?:có|đã|vừa|mới)\s+(?:bảo|nói|kể|than|phản\s+ánh)\b"
REASONS = ("lời kể quá khứ", "phủ định/cấm", "ước đoán", "dẫn lời")
GROUP_AGREES = (
    r"\b(?:mọi\s+người|cả\s+(?:nhóm|team|lớp)|nhóm(?:\s+mình)?|team(?:\s+mình)?)\s+(?:(?:đã|cùng|đều|vừa)\s+)*(?:đồng\s+ý|thống\s+nhất|nhất\s+trí)\b"
)
SENTENCE_GAP = r"(?<=[.!?])\s+"
THEN_START = r"^(?:(?:và|thì)\s+)?(?:rồi|sau\s+đó|xong(?:\s+rồi)?(?:\s+thì)?)\s+"
ALSO = r"\b(?:và|cùng|cũng|đồng thời)\b"
OLD_INTENTION = r"\b(?:ban\s+đầu|lúc\s+đầu|dự\s+định\s+giao|định\s+giao|tính\s+giao)\b"
NEW_DEADLINE = r"\b(?:gia\s+hạn|dời\s+hạn|lùi\s+hạn|đổi\s+hạn|hạn\s+mới)\b"
NO_CONTENT = (
    "làm lại gửi viết nộp sửa chạy test update cập nhật phụ trách hoàn thành thực hiện cố gắng xong "
    "bản phần việc file cái các những từng mỗi mọi "
    "và cùng cũng với cho của để là thì mà nên rồi luôn nhé nha nữa thôi ạ gấp sớm ngay "
    "trước sau vào đến này đó kia thứ tuần tháng ngày hôm nay mai chủ "
    "lúc giờ phút hai ba tư năm sáu bảy nhật"
)
WAITING_TASK = r"(?:còn\s+)?(?:một\s+việc\s+nữa\s+là|việc\s+nữa\s+là|một\s+việc\s+là|tiếp\s+theo\s+là)\s+(?P<what>\S.*?)(?:\s*[,.;:!?]\s*)?$"
OWNER_FOR_WAITING = (
    r"^việc\s+(?:này|đó)\s+(?:để\s+(?:mình|tôi|em)\s+(?:sẽ\s+)?(?:làm|phụ\s+trách)"
    r"|(?:bạn\s+)?[A-ZÀ-Ỹa-zà-ỹ]+(?:\s+[A-ZÀ-Ỹa-zà-ỹ]+)?\s+(?:sẽ\s+)?(?:làm|phụ\s+trách))"
)
LISTS_PEOPLE = r"\b[A-ZÀ-Ỹ][A-Za-zÀ-Ỹ]*\s+làm\b.*?,\s*[A-ZÀ-Ỹ][A-Za-zÀ-Ỹ]*\s+làm\b"
CLOSING_SENTENCE = r"^(?:ok|cảm ơn|vậy thôi|chào)\b"
FRAGMENT_SENTENCE = r"(?:để|phụ trách|làm)\b.*"
CLOSING_CLAUSE = r"^(?:nếu không|vậy thôi|cảm ơn|ok|chào)\b"
ALREADY_DONE = r"\bđã\s+.*\bxong\b"
FRAGMENT_CLAUSE = r"(?:để|phụ trách|làm|xong|test chung|có ai.*|ai.*\?)"
DEADLINE_CLAUSE = r"^(?:deadline|hạn chót|hạn)\b"
EMPTY_TASKS = ("họp", "đầu tiên là", "tiếp theo là", "điều này", "theo điều này")
BEFORE_DEADLINE = r"(?:(?:hạn\s+chót|deadline|hoàn\s+thành)\s+là\s+|chậm\s+nhất\s+là\s+|chậm\s+nhất\s+|trước\s+|vào\s+|đến\s+|cho\s+|là\s+)*"
HOUR_AFTER_DEADLINE = r"(?:\s+(?:lúc\s+)?\d{1,2}(?:\s*giờ|h)(?:\s*\d{1,2})?)?"
#: Rewrites of a task's description; {owner}: the escaped name of its owner, {doers}: DOER_VERBS
DESCRIPTION_STARTS = (
    r"^\s*(?:còn\s+)?(?:một\s+việc\s+nữa\s+là|việc\s+nữa\s+là|một\s+việc\s+là)\s*",
    r"^\s*(?:tiếp\s+theo\s+là|đầu\s+tiên\s+là|cuối\s+cùng\s+là|thứ\s+\d+\s+là)\s*",
    r"^\s*việc\s+(?:này|đó)\s+",
)
HANDED_TO_OWNER = r"\b(?:giao\s+cho|chuyển\s+(?:sang\s+)?cho|phụ\s+trách)\s+(?:(?:bạn|anh|chị|em|cô|chú)\s+)?{owner}\b\s*"
SUBJECTS = (
    r"\b(?:bạn|anh|chị|em)\s+(?!(?:{doers})\b)[A-ZÀ-Ỹa-zà-ỹ]+\s+",
    r"\b[A-ZÀ-Ỹa-zà-ỹ]+\s+(?:sẽ|phải|nên|cần|nhớ)\s+",
    r"\b(?:để|việc này\s+để|nên)\s+",
    r"\b(?:mình|tôi|em)\s+(?:sẽ\s+)?",
    r"^(?:bên|trong|ở|tại)\s+[^,;.!?]+?\s+(?:sẽ|phải|nên|cần|nhớ)\s+",
)
CHAIR_SUBJECT = r"^\s*(?:việc này\s+)?(?:để\s+)?(?:mình|tôi|em)\s*(?:sẽ\s+)?"
DUTY_START = r"^(?:phụ\s+trách|để|làm(?!\s+lại\b)|nên|cố\s+gắng)\s*[,;:.-]*\s*"
PLACE_STARTS = (r"^(?:bên|trong|ở|tại|trên)\s+[A-ZÀ-Ỹa-zà-ỹ]+(?:\s+[A-ZÀ-Ỹa-zà-ỹ]+){0,3}\s*[,;:.-]*\s*", r"^(?:trên|tại|ở)\s+")
SIGNAL_START = r"^(?:phải|cần|nên|sẽ)\s+"
IS_START = r"^(?:là|đó\s+là)\s+"
DESCRIPTION_TAILS = (
    (r"(?:,\s*)?(?:còn\s+)?(?:ai\s+có\s+ý\s+kiến\s+gì\s+không\?|có\s+ai\s+.*\bý\s+kiến\b.*\?|cảm\s+ơn.*|để\s+thứ\s+\d+\s+mình\s+test\s+chung.*)$", True),
    (r"\s+[,;]$", False),
    (r"\s*[,;]\s*(?:để|và|cùng|cũng)\s+.*$", True),
)

# decisions
DECISION_VERBS = r"\b(?:chốt|thống\s+nhất|quyết\s+định|đồng\s+ý)\b"
DECISION_TERMS = r"\b(?:kpi|không\s+dùng|tối\s+thiểu|miễn\s+phí\s+vận\s+chuyển)\b"
NEGATED_BEFORE = r"\b(?:đừng(?:\s+[^\s,.;:]+){0,6}|(?:chưa|không|chẳng|chả)(?:\s+[^\s,.;:]+){0,2})\s*$"
PURPOSE_BEFORE = r"\b(?:để|nhằm)\s+(?:cùng\s+)?$"
REGULATION = (
    r"\btừ\s+(?:tuần|tháng)\s+(?:này|sau|tới)\b(?!\s+(?:đến|tới|cho\s+đến))"
    r"|\btừ\s+(?:hôm\s+nay|nay|giờ|bây\s+giờ|buổi\s+(?:sau|tới)|lần\s+(?:sau|tới))\b(?!\s+(?:đến|tới|cho\s+đến))"
    r"|\b(?:phải|bắt\s+buộc)\s+được\b[^.]{0,60}?\btrước\s+khi\b|\bmỗi\b.*\bphải\s+đạt\b"
)
DISCOUNT = r"\b(chỉ giảm|giảm\s+10%|giảm\s+20%)\b"
TOPIC_TAIL = r",\s*(?:cuối\s+cùng|tiếp\s+theo|còn\s+lại)\s+là\s+(?P<topic>[^\s.,;]+(?:\s+[^\s.,;]+){0,2})\s*\.?\s*$"
CONTINUES = r"^(?:kèm|và|cùng)\b"

# next meeting
OPENING = r"\b(?:bắt đầu|mở đầu|chào mọi người).*\b(?:buổi\s+họp|họp\s+giao\s+ban)\b"
NEXT_MEETING = (
    r"họp\s+(?:tiếp theo|kế\s+tiếp|sau|tiếp)|buổi\s+họp\s+(?:tiếp theo|sau)|\b(?:buổi|cuộc|lần)\s+(?:họp|gặp)\s+(?:tiếp\s+theo|kế\s+tiếp|sau|tới)\b"
    r"|\bhọp\s+lần\s+(?:tới|sau|tiếp\s+theo)\b|\blần\s+sau\s+(?:(?:mình|chúng\s+ta|cả\s+nhóm)\s+)?(?:gặp|họp)\b"
)
DAYTIME_MEETING = (r"\b(?:tối|sáng|chiều|buổi|ngày)\s+.*(?:họp|meeting)\b", r"\b(?:lúc|tại|online|Google Meet|thứ)\b")
MEETING_VALUE = (
    r"(?:(?:buổi|cuộc|lần)\s+(?:họp|gặp)\s+(?:tiếp\s+theo|kế\s+tiếp|sau|tới)|(?:buổi\s+)?họp\s+(?:tiếp\s+theo|kế\s+tiếp|sau)"
    r"|(?:lịch\s+)?họp\s+lần\s+(?:tới|sau)|lần\s+sau\s+(?:(?:mình|chúng\s+ta|cả\s+nhóm)\s+)?(?:gặp|họp)(?:\s+(?:nhau|lại))?"
    r"|lịch\s+họp(?:\s+(?:tiếp\s+theo|kế\s+tiếp|sau|tới))?)(?:\s+(?:chốt|dự\s+kiến|sẽ\s+tổ\s+chức|sẽ\s+diễn\s+ra|sẽ))?"
    r"\s*(?:là|vào|:)?\s*(?P<value>.*?)(?:\.(?=\s|$)|$)"
)
DAYTIME_VALUE = r"\b(?:tối|sáng|chiều|buổi)\s+.*?(?:\.(?=\s|$)|$)"
PLACE_SENTENCE = r"^\s*(?:họp\s+)?(?:địa\s+điểm|tại|ở|trên|online|trực\s+tuyến|phòng|hội\s+trường|google\s+meet|zoom|teams|room)\b"
PLACE_START = r"^(?:họp\s+)?(?:địa\s+điểm\s*(?:là|:)?\s*)?(?:tại|ở)?\s*"
PLACE_WORDS = 10
NOT_SETTLED = r"\b(?:thông\s+báo\s+lại|báo\s+lại\s+sau|chưa\s+(?:chốt|có\s+lịch|biết|rõ)|(?:bị\s+)?hủy)\b"
TIME_AND_PLACE = r"^(?P<time>\S.*?)(?:\s*,\s*|\s+)(?:(?:tại|ở)\s+(?P<at>\S.*)|(?P<place>(?:online|phòng|hội\s+trường)\b.*))$"

# summary
SUMMARY_SHARE, SUMMARY_LEAST, SUMMARY_LEAST_KEPT, SUMMARY_MOST = 0.4, 4, 3, 7
REDUNDANCY, LEAD_BONUS = 0.5, 0.3
ASSIGN_PENALTY, MEETING_PENALTY, KNOWN_PENALTY = 0.2, 0.5, 0.3
SENTENCE_WORDS, SUMMARY_WORDS = 40, 150
CANDIDATE_WORDS, CANDIDATE_WORDS_FEW = 7, 4
TERM_BONUS = (
    ("chốt", 0.35), ("thống nhất", 0.35), ("quyết định", 0.4), ("đồng ý", 0.3), ("%", 0.15), ("tỷ", 0.15), ("hôm nay", 0.1), ("mục tiêu", 0.15), ("tối thiểu", 0.15),
)
DECISION_WORDS = ("chốt", "thống nhất", "quyết định", "đồng ý")
NUMBER_BONUS = (r"\d+%|\d+\s+triệu|\d+\s+tỷ|\d+\s+đơn|\d+\s+giờ", 0.15)
CONTENT_BONUS = (("nguyên nhân", "vì vậy", "tập trung", "vấn đề", "kết quả", "budget", "ngân sách"), 0.2)
SUMMARY_OPENER = r"^(?:đầu tiên|tiếp theo|thứ\s+\d+|cuối cùng|ngoài ra|bên cạnh đó)\s*(?:là)?\s*[,:]?\s*"
ABOUT_TOPIC = r"^về\s+(?P<topic>[^,]{2,30}?)\s+thì\s+"
CUT_TAIL = r"\s*,?\s*cuối cùng là\s+\S+(?:\s+\S+){0,2}\s*$"
SUMMARY_REWRITES = (
    (r"\b(?:bên|của)\s+mình\b", "công ty", False),
    (r"\bmình\s+(?=(?:sẽ|đã|định|có|họp)\b)", "", True),
    (r",\s*vì vậy,\s*", ". Vì vậy, ", False),
    (r"\b(?:lúc đầu|ban đầu)\s+", "", False),
    (r"\s+", " ", False),
)
SUMMARY_ASSIGNS = (
    r"\b(?:sẽ|phải)\s+(?:làm|gửi|viết|sửa|test|update|cập nhật|nộp|hoàn thành|chuẩn bị|liên hệ|chạy|thiết kế|thực hiện)\b"
    r"|phụ trách|giao cho|chậm nhất|trước\s+(?:thứ|ngày|chủ nhật)|để\s+(?:mình|tôi|em)\s+(?:sẽ\s+)?làm"
)
SUMMARY_MEETING = (
    r"họp\s+(?:lại|tiếp|lần\s+sau)\b|(?:buổi|cuộc)\s+họp\s+(?:sau|tiếp)|buổi\s+gặp\s+(?:kế\s+)?tiếp"
    r"|\bhọp\b.*(?:\d+\s*(?:giờ|h)\b|thứ\s+\d|chủ nhật|tuần sau|tuần tới)|google\s+meet|phòng\s+họp"
)
SUMMARY_SPLIT = r"(?<=[.!?])(?:\s+|(?=[A-ZÀ-ỸĐ]))"
SUMMARY_SMALL_TALK = r"nghe rõ không|bắt đầu\s+(?:buổi\s+)?(?:họp|cuộc họp)|có ai\s+(?:muốn|có)|chắc là đủ rồi|cảm ơn|không tính thành việc"
SUMMARY_KEEP = r"quyết định|thống nhất|đồng ý"

# output checks
BAD_FIRST_WORDS = ("lại", "xong", "để", "với", "và", "cho", "nữa", "thì", "mà", "nên", "rồi", "luôn")
STRAY_MARKS = (".", ",", ";", ":")
DEADLINE_PHRASES = ("chậm nhất là", "hạn chót là", "deadline là", "trước thứ", "trước ngày")

# ---- end of fixed values --------------------------------------------------------------------
