"""Word lists, names, patterns and messages that results depend on."""

from __future__ import annotations

#: Groups of words that mean the same in a question.
SYNONYM_GROUPS: tuple[tuple[str, ...], ...] = (
    ("学生事务处", "学生事务", "student affairs", "office of student affairs", "osa"),
    ("教务处", "教务", "registry", "academic affairs"),
    ("图书馆", "library"),
    ("奖学金", "scholarship", "financial aid"),
    ("学生证", "校园卡", "student card", "campus card"),
    ("培养方案", "修读计划", "programme requirements", "program requirements", "study scheme"),
    ("必修课", "必修课程", "required course", "required courses", "compulsory course"),
    ("选修课", "选修课程", "elective", "elective course", "elective courses"),
    ("学分", "credit", "credits"),
    ("本科生", "本科", "undergraduate", "undergraduates"),
    ("研究生", "硕士生", "博士生", "postgraduate", "graduate student", "graduate students"),
    ("游戏", "游戏制作", "游戏开发", "游戏设计", "电子游戏设计与开发", "game development", "game design", "video games design and development"),
    ("bio", "生物", "生命科学", "化学与生命科学", "biology", "biological sciences", "life sciences"),
)

#: Questions that ask for a list of things.
AGGREGATE_PATTERNS = (
    "(?:有|包含|开设|提供)(?:哪|什么)(?:些|几)(?:专业|课程|项目|学院|学系|部门|方向|服务|设施)",
    "(?:全部|所有|完整)(?:的)?(?:专业|课程|项目|学院|学系|部门|方向|服务|设施|清单|列表)",
    "(?:列出|罗列|汇总|盘点).{0,12}(?:专业|课程|项目|学院|学系|部门|方向|服务|设施)",
    r"(?i)\b(?:list|all)\b.{0,40}\b(?:majors?|programmes?|programs?|courses?|departments?|services?)\b",
    r"(?i)\bwhat\b.{0,40}\b(?:majors?|programmes?|programs?|courses?)\b.{0,20}\b(?:offer|available)\w*\b",
)

#: Answer modes, and the words that choose one, in order.
OFFICIAL_FACT, COURSE_EXPLANATION, LEARNING_PLAN = "official_fact", "course_explanation", "learning_plan"
LEARNING_PATTERN = "学习路线|学习计划|怎么学|如何学习|前置知识|先学什么|练习项目|study plan|learning path|how to learn"
COURSE_PATTERN = "介绍|讲讲|是什么课|有什么用|课程内容|难不难|课程简介|what is|introduce|overview"

DEPARTMENTS = (
    ("学生事务处", "Office of Student Affairs"),
    ("教务处", "Registry"),
    ("图书馆", "Library"),
    ("研究生院", "Graduate School"),
    ("职业规划与发展处", "Career Planning and Development Office"),
)

#: Contact fields of a page, at most 20 values each.
FIELD_PATTERNS = {
    "emails": r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])",
    "phones": r"(?:(?:\+?86[-\s]?)?(?:0\d{2,3}[-\s]?)?\d{7,8})(?:[-\s]?转?\d{1,5})?",
    "office_hours": r"(?:办公|工作|服务|开放|接待)(?:时间|时段)[：:]?[^\n。；;]{2,100}",
    "locations": r"(?:办公|联系|服务|办事)(?:地址|地点)[：:]?[^\n。；;]{2,100}",
}
FIELD_LABELS = {"emails": "邮箱", "phones": "电话", "office_hours": "办公时间", "locations": "办公地点"}
MOST_FIELD_VALUES = 20
UPDATED_PATTERN = r"(?:更新|发布日期|发布时间|Last\s+Update(?:d)?)[：:\s]*(20\d{2}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?)"

SKIPPED_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".pdf")

UNKNOWN_DOCUMENT = "未知文档"
SCOPE_MARK = "_适用于"
CONTEXT_MARK = "\n相关上文："

REFUSALS = {
    "zh": "抱歉，我暂时没能从现有校园资料中找到足够信息来确认这个问题。你可以补充具体的专业、入学年份或事项名称，我会再帮你仔细找找。",
    "en": "Sorry, I couldn't find enough information in the available campus sources to confirm this. You can add your programme, entry year, or the specific service name, and I'll look again.",
}
DISCLAIMERS = {
    COURSE_EXPLANATION: "通用介绍部分基于一般学科知识，不代表学校官方教学大纲。",
    LEARNING_PLAN: "以下为通用学习建议，不代表学校官方教学安排。",
}

#: Years in a question that name a version.
YEAR_PATTERN = r"(?i)(?:20)?\d{2}\s*(?:至|[-–—/])\s*(?:20)?\d{2}|20\d{2}\s*(?:级|年|entry)"
APPLICABILITY_PATTERN = r"(?i)^(.+)_适用于(.+?)\.pdf\n?$"

#: Grades and the status that each gives; anything else is unknown.
GRADE_STATUS = {
    "withdrawn": ("W", "WD", "WITHDRAW", "WITHDRAWN"),
    "in_progress": ("IP", "IN PROGRESS", "正在修读"),
    "failed": ("F", "FA", "U", "不及格", "FAIL"),
    "passed": ("A", "A-", "A+", "B", "B-", "B+", "C", "C-", "C+", "D", "D-", "D+", "P", "PA", "DI", "PASS", "及格"),
}

#: Traditional characters and their simplified forms, in pairs; callers may give a larger table.
TRADITIONAL = dict(
    pair
    for pair in (
        "學学 務务 處处 館馆 獎奖 證证 園园 卡卡 養养 劃划 課课 選选 業业 專专 項项 門门 設设 計计 開开 發发 電电 戲戏 遊游 "
        "與与 網网 頁页 書书 員员 師师 時时 間间 請请 條条 問问 題题 關关 於于 會会 體体 錄录 記记 圖图 數数 據据 類类 "
        "語语 讀读 寫写 習习 實实 驗验 術术 經经 濟济 財财 報报 費费 繳缴 補补 畢毕 國国 際际 漢汉 歷历 資资 訊讯 個个 "
        "們们 這这 還还 從从 來来 為为 麼么 麗丽 聯联 絡络 繫系 話话 號号 樓楼 層层 廳厅 臺台 灣湾 廣广 東东 職职 務务 "
        "須须 應应 當当 無无 種种 總总 結结 構构 組组 織织 機机 構构 環环 檢检 查查 詢询 導导 論论 證证 證证 達达 運运 動动"
    ).split()
    if len(pair) == 2
)
