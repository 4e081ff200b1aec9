"""Rule packs as data: keywords of document types, weights, priorities and slots. All are fixed values."""

from __future__ import annotations

# Document types and the keywords that speak for them, in order of precedence.
TYPE_KEYWORDS: dict[str, list[str]] = {
    "成绩单": ["成绩单", "成绩表", "课程", "学分", "GPA", "绩点", "总评", "统计时间"],
    "在校证明": ["在校生", "在读", "学生证明", "在校证明", "学籍证明"],
    "学籍信息卡": ["学籍信息卡", "学籍卡", "学籍信息", "学籍状态", "注册学籍"],
    "班级成员表": ["班级成员表", "班级成员", "成员名单", "班级名单", "序号", "班级", "姓名", "性别"],
    "毕业证书/学历证书": ["毕业证书", "学历证书", "普通高等学校", "经审核准予毕业"],
    "录取凭证": ["录取通知书", "录取通知", "录取学校", "新生", "录取专业"],
    "课程表": ["课程表", "上课时间", "周一", "周二", "节次", "教室"],
    "生源地助学贷款合同": ["生源地助学贷款", "贷款合同编号", "助学贷款在线服务系统", "国家开发银行"],
    "贷款合同": ["贷款合同", "借款合同", "借款人", "还款方式", "贷款金额"],
    "奖学金证明": ["奖学金", "助学金", "励志奖学金", "国家奖学金", "发放", "获奖"],
    "贫困证明": ["贫困", "经济困难", "低保", "家庭经济", "资助", "困难证明"],
    "收入证明": ["收入证明", "工资收入", "薪资", "月收入", "年收入"],
    "请假条": ["请假条", "请假申请", "请假", "事假", "病假", "假期", "销假"],
    "休学申请": ["休学申请", "休学", "复学", "休学原因"],
    "通知": ["通知", "公告", "告知", "决定", "安排"],
    "会议纪要": ["会议纪要", "会议记录", "会议时间", "参会人员", "议题"],
    "证明类其他": ["兹证明", "特此证明", "证明", "盖章"],
    "合同": ["合同", "协议", "甲方", "乙方", "签订"],
}
LEAVE_WORDS = ["请假", "销假", "请、销假", "请假离校原因", "拟返校时间", "辅导员老师", "指导老师意见", "本人承诺"]
ROSTER_WORDS = ["序号", "班级", "姓名", "性别"]

# Rules (type, any of, all of, none of, least hits of the first).
KEYWORD_RULES: list[tuple[str, list[str], list[str], list[str], int]] = [
    ("成绩单", ["成绩单", "学业成绩表", "成绩列表", "课程成绩", "学分绩点"], [], ["贷款合同", "借款人"], 1),
    ("课程表", ["课程表", "课表", "上课时间", "节次", "周一", "周二", "周三", "周四", "周五"], [], [], 1),
    ("学籍卡", ["学籍卡", "学籍信息卡"], [], ["贷款合同", "借款人"], 1),
    ("学籍信息卡", ["学籍状态", "预计毕业日期", "学信网", "在线验证码", "注册学籍"], ["学籍"], ["贷款合同", "借款人"], 2),
    ("班级成员表", ["班级成员表", "班级成员名单", "班级成员", "成员名单", "班级名单"], ["班级"], ["贷款合同", "借款人"], 1),
    ("班级成员表", ["序号", "班级", "姓名"], ["班级", "姓名"], ["贷款合同", "借款人"], 2),
    ("在校证明", ["在校证明", "在读证明", "兹证明", "特此证明"], ["学生", "学号"], ["贷款合同"], 1),
    ("学籍证明", ["学籍证明"], ["学籍", "学生"], [], 1),
    ("贫困证明", ["家庭经济困难", "贫困证明", "困难学生"], ["兹证明"], [], 1),
    ("收入证明", ["收入证明", "工资收入", "月收入"], ["证明"], [], 1),
    ("奖学金证明", ["奖学金", "奖励", "表彰"], ["特此证明"], [], 1),
    ("实习证明", ["实习证明", "实习单位", "实习期间", "实习岗位"], ["实习"], [], 1),
    ("实习鉴定表", ["实习鉴定", "实习表现", "考核意见", "指导教师评语"], ["实习"], [], 1),
    ("实习协议书", ["实习协议", "三方协议", "实践教学安排"], ["甲方", "乙方"], [], 1),
    ("请假条", ["请假条", "请假申请", "请假单"], ["请假", "申请人"], [], 1),
    ("休学申请", ["休学申请", "休学申请表", "休学期间"], ["休学"], [], 1),
    ("复学申请", ["复学申请", "复学申请表"], ["复学"], [], 1),
    ("缓考申请表", ["缓考申请", "缓考申请表", "缓考课程"], ["缓考"], [], 1),
    ("重修申请表", ["重修申请", "重修申请表", "重修课程"], ["重修"], [], 1),
    ("转专业申请表", ["转专业申请", "转专业申请表"], ["转专业"], [], 1),
    ("转学申请表", ["转学申请", "转学申请表"], ["转学"], [], 1),
    ("奖学金申请表", ["奖学金申请", "奖学金申请表"], ["奖学金"], [], 1),
    ("奖学金审批表", ["奖学金评审表", "奖学金审批表", "评奖评优"], ["奖学金"], [], 1),
    ("助学金申请表", ["助学金申请", "助学金申请表"], ["助学金"], [], 1),
    ("贫困生认定申请表", ["家庭经济困难学生认定", "贫困生认定申请表"], ["认定", "家庭经济困难"], [], 1),
    ("录取通知", ["录取通知书", "兹录取你", "报到注意事项"], ["录取"], [], 1),
    ("录取凭证", ["录取凭证", "新生报到凭证"], ["录取"], [], 1),
    ("学位证书", ["学位证书"], ["学位"], [], 1),
    ("毕业证书/学历证书", ["毕业证书", "学历证书"], ["毕业"], [], 1),
    ("通知", ["通知", "关于", "决定"], [], ["会议纪要"], 1),
    ("会议纪要", ["会议纪要", "会议记录"], [], [], 1),
    ("处分决定书", ["处分决定书", "警告处分", "严重警告", "记过", "留校察看", "开除学籍"], ["处分"], [], 1),
    ("解除处分决定书", ["解除处分", "撤销处分"], [], [], 1),
    ("学生证", ["学生证"], ["学校", "学生"], [], 1),
    ("校园卡", ["校园卡", "一卡通"], [], [], 1),
    ("生源地助学贷款合同", ["生源地助学贷款", "生源地信用助学贷款"], ["贷款合同编号", "借款人"], ["学籍卡", "学籍信息卡"], 2),
    ("贷款合同", ["贷款合同", "借款人", "贷款金额", "还款期限"], ["贷款"], ["学籍卡", "学籍信息卡"], 2),
]
HIGH_PRIORITY = ["生源地助学贷款合同", "贷款合同", "成绩单", "学籍卡", "学籍信息卡", "班级成员表", "在校证明", "学籍证明"]
MID_PRIORITY = ["课程表", "课表", "贫困证明", "收入证明", "奖学金证明", "实习证明", "实习鉴定表", "请假条", "休学申请", "复学申请", "录取通知", "录取凭证"]

# The primary class of each document type; types not listed are "other".
PRIMARY_CLASS: dict[str, str] = {
    "成绩单": "transcript", "学业成绩表": "transcript", "成绩单/学业成绩表": "transcript", "课程表": "transcript", "课表": "transcript", "课表/选课单": "transcript",
    "学籍卡": "student_record", "学籍信息卡": "student_record", "班级成员表": "student_record", "学籍证明": "student_record", "在校证明": "enrollment_proof", "学籍证明/在校证明": "enrollment_proof",
    "贫困证明": "certificate", "收入证明": "certificate", "奖学金证明": "certificate", "证明类其他": "certificate", "实习证明": "certificate", "实习鉴定表": "certificate",
    "实习协议书": "certificate", "毕业实习鉴定": "certificate", "请假条": "leave_application", "休学申请": "leave_application", "复学申请": "leave_application", "缓考申请表": "application_exam",
    "重修申请表": "application_exam", "转专业申请表": "application_change_major", "转学申请表": "application_transfer", "奖学金申请表": "application_scholarship", "奖学金审批表": "application_scholarship", "助学金申请表": "application_grant",
    "贫困生认定申请表": "application_grant", "录取通知": "admission", "录取凭证": "admission", "毕业证书/学历证书": "certificate", "学历证书": "certificate", "毕业证书": "certificate",
    "学位证书": "certificate", "合同": "contract", "贷款合同": "loan_contract", "生源地助学贷款合同": "loan_contract", "通知": "notice", "通知/公告": "notice",
    "会议纪要": "meeting_minutes", "处分决定书": "discipline", "解除处分决定书": "discipline", "学生证": "card", "校园卡": "card", "其他": "other",
    "generic_document": "other",
}

# Entity type to field (name, field type, confidence).
SLOTS: dict[str, tuple[str, str, float]] = {
    "PERSON": ("name", "PERSON", 0.85),
    "STUDENT_ID": ("student_id", "STUDENT_ID", 0.85),
    "ID_NUMBER": ("id_number", "ID_NUMBER", 0.9),
    "PHONE": ("phone", "PHONE", 0.85),
    "LEAVE_REASON": ("reason", "TEXT", 0.8),
    "LEAVE_START_DATE": ("start_date", "DATE", 0.75),
    "LEAVE_END_DATE": ("end_date", "DATE", 0.75),
    "LEAVE_DAYS": ("days", "NUMBER", 0.7),
    "LEAVE_LOCATION": ("address", "ADDRESS", 0.7),
    "RETURN_DATE": ("expected_grad_date", "DATE", 0.6),
    "PARENT_PHONE": ("contact", "PHONE", 0.6),
    "TEACHER": ("issuer", "PERSON", 0.55),
    "COUNSELOR": ("admission_school", "PERSON", 0.55),
    "MONEY_AMOUNT": ("loan_amount", "NUMBER", 0.7),
    "LOAN_TERM_MONTH": ("loan_years", "NUMBER", 0.65),
}

_HAN = "一-龥"
_DATE = r"[0-9]{4}[-年/\.][0-9]{1,2}[-月/\.]?[0-9]{0,2}"
# Entity rules in order, each published pattern cut at its group (type, before the value, value, after the value).
ENTITY_RULES: list[tuple[str, str, str, str]] = [
    ("PERSON", r"(?:姓名|学生|申请人|联系人)[:：]?\s*", r"[^\s\n]{2,10}", ""),
    ("PERSON", r"姓名\s+", r"[^\s\n]{2,10}", ""),
    ("ID_NUMBER", r"(?:身份证号码|身份证号|身份证)[:：]?\s*", r"\d{17}[\dXx]", ""),
    ("WECHAT", r"(?:微信号|微信)[:：]?\s*", r"[A-Za-z][A-ZaZ0-9_-]{4,20}", ""),
    ("QQ", r"(?:QQ号|QQ)[:：]?\s*", r"\d{5,12}", ""),
    ("EMAIL", r"(?i:E-?mail)[:：]?\s*[_ ]*", r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9\-.]+", ""),
    ("PHONE", r"(?:本人手机号|手机号|手机)[:：]?\s*[_ ]*", r"1[3-9]\d{9}", ""),
    ("CLASS", r"(?:班级|所在班级|行政班)[:：]?\s*", rf"[A-Za-z0-9{_HAN}]{{2,20}}", ""),
    ("COLLEGE_NAME", r"(?:学院|院系|系所|院系名称)[:：]?\s*", r"[^\n\r]{2,40}", ""),
    ("MAJOR_NAME", r"(?:专业|专业名称)[:：]?\s*", r"[^\n\r]{2,40}", ""),
    ("LOAN_CONTRACT_NO", r"(?:贷款合同编号|合同编号)[:：]?\s*", r"[A-Za-z0-9\-]{6,40}", ""),
    ("VERIFY_CODE", r"(?:回执验证码|在线验证码|验证码)[为是]?[:：]?\s*", r"\d{4,10}", ""),
    ("BANK_ACCOUNT_NO", r"(?:银行账号|账号|卡号)[:：]?\s*", r"\d{6,30}", ""),
    ("LOAN_BANK_NAME", r"(?:开户行|开户银行|贷款银行|银行)[:：]?\s*", r"[^\n\r]{4,60}", ""),
    ("STUDENT_ID", r"(?:学号|学籍号|学生编号)\s*[:：]?\s*[_\s]*", r"[0-9]{6,12}", ""),
    ("STUDENT_ID", r"学号.{0,10}?", r"[0-9]{6,12}", ""),
    ("ID_NUMBER", r"\b", r"\d{17}[\dXx]", r"\b"),
    ("STUDENT_ID", r"\b", r"\d{8,15}", r"\b(?=.*学号)"),
    ("DATE", "", r"\d{4}[-年/\.]\d{1,2}[-月/\.]?\d{1,2}[日]?", ""),
    ("PHONE", "", r"1[3-9]\d{9}", ""),
    ("EMAIL", "", r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9\-.]+", ""),
    ("CLASS", "", rf"[A-Za-z0-9{_HAN}]{{2,10}}", ""),
    ("NATION", "", rf"[{_HAN}]{{1,4}}", ""),
    ("GENDER", "", r"男|女", ""),
    ("STATUS_ACADEMIC", "", r"在籍|在校|毕业|结业|肄业|休学|退学", ""),
    ("COLLEGE_NAME", r"(?:分院|学院|院系|系所)[:：]?\s*", r"[^\s\n]{2,30}", ""),
    ("MAJOR_NAME", r"(?:专业)[:：]?\s*", r"[^\s\n]{2,30}", ""),
    ("PROGRAM_LEVEL", r"(?:层次|学历类别|学习形式)[:：]?\s*", r"[^\s\n]{2,20}", ""),
    ("ENROLL_DATE", r"(?:入学日期|入学时间|入学)[:：]?\s*", _DATE, ""),
    ("EXPECTED_GRAD_DATE", r"(?:预计毕业日期|毕业日期|毕业时间)[:：]?\s*", _DATE, ""),
    ("LOAN_AMOUNT", r"(?:贷款金额|贷款数额|借款金额)[:：]?\s*", r"[0-9]+(?:\.[0-9]+)?", ""),
    ("LOAN_TERM_MONTH", r"(?:贷款期限|贷款年限|还款期限)[:：]?\s*", r"[0-9]{1,2}", ""),
    ("LOAN_YEAR", r"贷款年度[:：]?\s*", r"[0-9]{4}", ""),
    ("LOAN_BANK_NAME", r"(?:贷款银行|开户行|银行)[:：]?\s*", r"[^\s\n]{2,40}", ""),
    ("LOAN_CONTRACT_NO", r"(?:合同编号|贷款合同编号)[:：]?\s*", r"[A-Za-z0-9\\-]{4,40}", ""),
    ("SCHOLARSHIP_NAME", "", r"国家奖学金|励志奖学金|奖学金|助学金|资助|困难补助|减免", ""),
    ("SCHOLARSHIP_AMOUNT", r"(?:奖学金金额|资助金额|金额)[:：]?\s*", r"[0-9]+(?:\.[0-9]+)?", ""),
    ("APPLICATION_TYPE", r"(?:申请类别|申请类型|请假类别|请假类型)[:：]?\s*", r"[^\s\n]{2,10}", ""),
    ("APPLICATION_REASON", r"(?:请假|事由|原因|申请理由)[:：]?\s*", r"[^\n]{2,60}", ""),
    ("LEAVE_START_DATE", r"(?:开始日期|起始日期|请假开始|休学开始)[:：]?\s*", _DATE, ""),
    ("LEAVE_END_DATE", r"(?:结束日期|终止日期|请假结束|休学结束)[:：]?\s*", _DATE, ""),
    ("CERT_ID", r"(?:证书编号|编号)[:：]?\s*", r"[A-Za-z0-9\\-]{4,40}", ""),
    ("DOC_ISSUER_ORG", r"(?:签发单位|发证单位|发放单位|主管单位)[:：]?\s*", r"[^\s\\n]{2,40}", ""),
    ("ADDRESS_FULL", r"(?:地址|住址|联系地址)[:：]?\s*", r"[^\\n]{6,80}", ""),
    ("BANK_ACCOUNT_NO", r"(?:账号|银行账号|卡号)[:：]?\s*", r"[0-9]{6,30}", ""),
    ("VERIFY_CODE", r"(?:回执验证码|在线验证码|验证码)[为是]?[:：]?\s*", r"\d{4,10}", ""),
    ("LEAVE_LOCATION", r"(?:外出地点|外出地点、时间|外出地点|地点)[:：]?\s*", r"[^\n]{2,80}", ""),
    ("RETURN_DATE", r"(?:拟返校时间|返校时间|拟返校)[:：]?\s*", r"[^\n]{4,40}", ""),
    ("LEAVE_REASON", r"(?:请假(?:离校)?原因|请假事由|事由|原因)[:：]?\s*", r"[^\n]{2,120}", ""),
    ("LEAVE_DAYS", r"(?:请假天数|请假\s*天数|天数)[:：]?\s*", r"[0-9]{1,3}(?:\.[0-9])?", ""),
    ("TEACHER", r"(?:指导教师|指导老师)[:：]?\s*", rf"[{_HAN}]{{2,6}}", ""),
    ("COUNSELOR", r"(?:辅导员(?:老师)?|辅导员)[:：]?\s*", rf"[{_HAN}]{{2,6}}", ""),
    ("PARENT_NAME", r"(?:家长姓名及手机|家长姓名(?:及手机)?|家长姓名)[:：]?\s*", rf"[{_HAN}]{{2,6}}", ""),
    ("PARENT_PHONE", r"(?:家长姓名及手机|家长手机|家长电话|家长联系方式)[:：]?\s*[_ ]*", r"1[3-9]\d{9}", ""),
]

#: Rules whose value is the rest of a line: what they take for a college, major or bank must be no label.
LINE_VALUE_RULES = (8, 9, 13)
