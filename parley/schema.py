"""Row types of the logical tables."""

#: One utterance of a meeting; ``source`` names the meeting, ``pos`` its place in time order.
TRANSCRIPT = "source string, pos int, speaker string, start double, `end` double, text string"
CLEAN = "source string, pos int, stt int, speaker string, start double, `end` double, goc string, sach string, tach_tu string, xa_giao boolean"
TASK = "struct<task:string,owner:string,deadline:string,start:double>"
DECISION = "struct<text:string,start:double>"
NEXT_MEETING = "struct<time:string,place:string,start:double>"
RESULT = f"source string, summary string, decisions array<{DECISION}>, tasks array<{TASK}>, next_meeting {NEXT_MEETING}"
WORD = "struct<start:double,end:double,word:string,probability:double>"
SEGMENT = (
    "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,"
    f"compression_ratio:double,temperature:double,tokens:array<int>,words:array<{WORD}>>"
)
EVAL_LABEL = "id string, tep string, text string, nhom string, nguon string, row_idx bigint, tu_doan array<string>, nguon_bo string"
EVAL_DETAIL = "struct<start:double,end:double,text:string,do_tin_cay:double,khong_co_tieng:double,ty_le_nen:double,nhiet_do:double,so_token:int,loai:string>"
EVAL_RESULT = f"id string, cfg string, du_doan string, bi_loai array<string>, do_dai double, thoi_gian double, chi_tiet array<{EVAL_DETAIL}>, loi string"
REQUIRED = "struct<chu:string,tu_khoa:array<string>,han:string,han_bi_thay:string>"
LABELS = (
    f"struct<tap:string,viec_bat_buoc:array<{REQUIRED}>,viec_tuy_chon:array<{REQUIRED}>,viec_cam:array<{REQUIRED}>,"
    "quyet_dinh:array<struct<tu_khoa:array<string>>>,quyet_dinh_tuy_chon:array<struct<tu_khoa:array<string>>>,lich_hop:map<string,string>>"
)
