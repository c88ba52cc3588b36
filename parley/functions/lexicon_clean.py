"""Fixed values of transcript cleaning: they must be these for right results.

Everything here is data: ordered rewrite rules, filler words, small-talk
patterns.  Operators take a ``CleaningLexicon`` so that other languages can
bring their own.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values ---------------------------------------------------------------------------

_HONORIFIC = r"(?<!chị )(?<!em )(?<!bạn )(?<!cô )(?<!anh )(?<!bà )(?<!ông )(?<!thầy )"
_WEEKDAY = r"(?:thứ\s+(?:\d|hai|ba|tư|năm|sáu|bảy)|chủ\s+nhật|ngày\s+\d+(?:\s+tháng\s+\d+)?|cuối\s+tuần)"

#: Misheard words and what they stand for, applied in this order, ignoring case.
REWRITES = (
    (_HONORIFIC + r"\bbích\s+link\b", "deadline"),
    (
        r"^(?!.*\b(?:đầu\s+tiên|thứ\s+nhất)\b)((?:.*?[.?!]\s)?)bích\s+linh\b(?=\s+là\s+" + _WEEKDAY
        + r"(?:\s+(?:tuần|tháng)\s+(?:này|sau|tới))?(?:\s+(?:nhé|nha|nhá))?\s*(?:[.!?]|,(?!\s*\S+(?:\s+\S+)?\s+là\s+thứ\b)|$))",
        r"\1deadline",
    ),
    (r"\bphôn\s+th[eê]n\b|\bfront\s*-\s*end\b", "frontend"),
    (r"\b(phần|bên|team|code)\s+bắt\s+kênh\b", r"\1 backend"),
    (r"\bbackgnd\b|\bback\s*-\s*end\b", "backend"),
    (r"\bdead\s*-\s*line\b", "deadline"),
    (r"\bup\s*-\s*load\b|\bupo\s+lát\b", "upload"),
    (r"\bp\s+ra\s+chất\b", "project"),
    (r"\bmeet\s+thinh\b", "meeting"),
    (r"(?<!cho )(?<!được )(?<!xin )\bphép\s+bắt\b(?=\s+(?:là|về))", "feedback"),
    (r"\b(?-i:tết)\s+thử\b(?!\s+nghiệm)", "test thử"),
    (r"\brút\s+(?:dalo|da\s+lô|giá\s+lô)\b", "group Zalo"),
    (r"\b(qua|dùng|sang|bằng)\s+misco\b", r"\1 MySQL"),
    (r"\bdọng\s+nói\b", "giọng nói"),
    (
        r"(?<!mùa )(?<!dùng )(?<!lên )(?<!bản )(?<!cấp )(?<!spring \d hay )(?<!spring \d\d hay )(?<!spring \d hoặc )(?<!spring \d\d hoặc )"
        r"\bSpring\b(?=\s*\d{1,2}\b(?![.,]\d)|\s+(?:tiếp|mới|này|sau|trước|tới|kế|đầu|hiện|planning|review|backlog|goal)\b)",
        "Sprint",
    ),
    (r"\b(sprint\s+\d{1,2}\s+(?:hay|hoặc)\s+)spring\b(?=\s*\d)", r"\1Sprint"),
    (r"\b(trên|qua|sàn)\s+shopping\b(?!\s+(?:mall|center|centre|online)\b)", r"\1 Shopee"),
    (r"\breact\b(?!-\w)", "React"),
    (
        r"^(?=.*\b(?:react|angular|frontend|giao\s+diện|component|javascript|framework)\b)"
        r"(.*?\b(?:dùng|không\s+dùng|qua|với|hay|thay\s+vì|bằng)\s+)view\b"
        r"(?=\s*(?:[,.!?;:]|$)|\s+(?:nữa|rồi|thay\s+vì|chứ|hay|hoặc|với|và|vì|nhé|nha|thì|luôn)\b)",
        r"\1Vue",
    ),
    (r"\bFacebook\b", "Facebook"),
    (r"\bTikTok\b", "TikTok"),
    (r"\blazada\b", "Lazada"),
    (r"\bGoogle Drive\b", "Google Drive"),
    (r"\bGoogle Meet\b", "Google Meet"),
    (r"\bMessenger\b", "Messenger"),
    (r"\bAPI\b", "API"),
    (r"\bSprint\b", "Sprint"),
)

#: Web addresses and dotted names, which no rewrite touches.
ADDRESS = r"(?<![\w-])(?:https?://)?[\w-]+(?:\.[\w-]+)+(?:/[\w-]+(?:\.[\w-]+)*)*/?"

#: A filler alone in brackets; a filler word; fillers that can bear meaning.
BRACKETED_FILLER = r"[(\[]\s*(?:ờ|ờm|ừ|ừm|ơ|à|ạ|nha|nhé|ok)\s*[)\]]"
FILLER_WORD = r"(?:ờ|ờm|ừ|ừm|ơ|à|(?-i:nha)|nhé|ok)"
MEANINGFUL_FILLERS = ("à", "ok", "nha")
FILLERS = (
    r"\b(?:ờ|ờm|ừ|ừm|ơ|ạ|nhé)\b"
    r"|\b(?-i:nha)\b(?!\s+(?:khoa|sĩ|thuốc|bè|trang\b(?!\s+chủ)))"
    r"|(?:^\s*|(?<=[.?!,;:…—–])\s*)à\b(?!\s+(?:không|quên|mà|đúng))(?!\s*\?)"
    r"|\bà(?=\s*(?:[.!]|$))"
    r"|^\s*ok\b(?!\s+(?:là|button|lắm|luôn|chưa|không|hết|rồi|nhất|quá)\b)(?!\s*\?)"
    r"|(?<=[.?!,;:…—–])\s*ok(?=\s*(?:[,.!]|$))"
    r"|(?:(?<=\dh )|(?<=\dh\d\d )|(?<=giờ )|(?<=phút ))ok(?=\s*[.!]?\s*$)"
)

#: White space and punctuation left behind, in this order.
TIDY = (
    (r"\s+", " "),
    (r"\s+([,.?!;:])(?!\w)", r"\1"),
    (r"([,;:])(?:\s*[,;:])+", r"\1"),
    (r"[,;:]\s*([.?!])(?!\w)", r"\1"),
    (r"\.{4,}", "..."),
    (r"(?<!\.)\.\.(?![.\w])", "."),
    (r"([?!])\.(?![.\w])", r"\1"),
    (r"^(?:[,;:?!\s]|\.(?!\w))+", ""),
    (r"(?<=\w[—–])\s+", ""),
)

GREETINGS = (
    r"^(?:(?:xin|em|mình|tôi|vậy|rồi|thôi|ok)\s+){0,2}c[ảá]m\s+ơn\b",
    r"^(?:xin\s+)?chào(?:\s+(?:mọi\s+người|cả\s+nhà|các\s+bạn|cả\s+nhóm|team|anh|chị|em|thầy|cô)\b|$)",
    r"^hello\b",
    r"^(?:thanks?|thank\s+you)\b",
    r"^(?:(?:xin|chào)\s+)?tạm\s+biệt(?:\s+(?:mọi\s+người|cả\s+nhà|các\s+bạn|team))?$",
    r"^hẹn\s+gặp\s+lại(?:\s+(?:mọi\s+người|cả\s+nhà|các\s+bạn|sau))?$",
    r"^bye(?:\s+bye)?(?:\s+(?:mọi\s+người|cả\s+nhà|các\s+bạn|team))?$",
    r"^(?:(?:vậy|thế|rồi|còn|giờ|ok|mọi\s+người|các\s+bạn|cả\s+nhà|anh\s+chị)\s+){0,2}có\s+ai\b.*(?:câu\s+hỏi|ý\s+kiến|thắc\s+mắc)",
    r"^(?:.*\bđủ(?:\s+rồi)?\s+thì\s+)?(?:(?:mình|chúng\s+ta|ta|giờ|bây\s+giờ|thôi|vậy|rồi|em|tôi|xin\s+phép)\s+){0,3}"
    r"bắt\s+đầu\s+(?:\S+\s+){0,3}?(?<!phòng )(?:họp|meeting)\b(?!\s+báo)",
    r"^(?:(?:mọi\s+người|cả\s+nhà|các\s+bạn|team)\s+)?(?:đã\s+)?vào\s+(?:đông\s+)?đủ\s+rồi",
)
SMALL_TALK_WORDS = 15
ASSIGNS = r"\b(?:sẽ|phụ\s+trách|nhớ|giao(?!\s+ban)|nhận|làm|gửi|nộp|sửa|fix|deploy|viết|chuẩn\s+bị)\b"
CLOSERS = (
    r"^(?:ok|rồi|vậy|vậy thôi|thế thôi|hết rồi|xong rồi|chào mọi người|chào cả nhà|chào các bạn|mọi người|các bạn|cả nhà|"
    r"(?:mình\s+|chúng\s+ta\s+)?bắt đầu(?:\s+thôi)?)$"
)
TIMES = (
    r"\blúc\b|\d+\s*(?:h|giờ)\b|\bthứ\s+(?:\d|hai|ba|tư|năm|sáu|bảy)\b|\bchủ\s+nhật\b|"
    r"\bngày\s+(?:\d|mai|kia)|\btuần\s+(?:sau|tới)\b|\btháng\s+(?:sau|tới|\d)"
)
COMPOUNDS = ("hạn chót", "cuộc họp", "phòng họp", "ban giám đốc", "group Zalo", "Google Drive", "Google Meet")

# ---- end of fixed values --------------------------------------------------------------------


@dataclass(frozen=True)
class CleaningLexicon:
    rewrites: tuple[tuple[str, str], ...] = REWRITES
    address: str = ADDRESS
    bracketed_filler: str | None = BRACKETED_FILLER
    filler_word: str | None = FILLER_WORD
    meaningful: tuple[str, ...] = MEANINGFUL_FILLERS
    fillers: str | None = FILLERS
    tidy: tuple[tuple[str, str], ...] = TIDY
    greetings: tuple[str, ...] = GREETINGS
    small_talk_words: int = SMALL_TALK_WORDS
    assigns: str = ASSIGNS
    closers: str = CLOSERS
    times: str = TIMES
    compounds: tuple[str, ...] = COMPOUNDS


VIETNAMESE = CleaningLexicon()

#: A stand-in for English text, for queries on tables without Vietnamese.
ENGLISH = CleaningLexicon(
    rewrites=((r"\bfront\s*-\s*end\b", "frontend"), (r"\bthe (the )+", "the "), (r"\bapi\b", "API")),
    bracketed_filler=r"[(\[]\s*(?:uh|um|er|ok)\s*[)\]]",
    filler_word=r"(?:uh|um|er|ok)",
    meaningful=("ok",),
    fillers=r"\b(?:uh|um)\b",
    greetings=(r"^(?:hello|hi|thanks?|thank you)\b", r"^(?:the|in|is)\b"),
    assigns=r"\b(?:will|must|send|write|fix)\b",
    closers=r"^(?:ok|all right|everyone|of|to)$",
    times=r"\b(?:at|on|today|tomorrow)\b|\d+\s*(?:am|pm)\b",
    compounds=("of the", "in the"),
)
