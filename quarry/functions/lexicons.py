"""Word lists and patterns of the text functions: fixed values, as plain text."""

#: Personal data; the order of masking matters.
EMAIL = r"(?U)[\w.-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)"
ID_CARD = r"(?U)(?<!\d)\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"

#: (type, severity, pattern) of instructions in untrusted text.
INJECTIONS = [
    ("指令覆盖", "high", r"(?iuU)忽略(上述|之前|以上|前面|所有|一切)?(所有|一切|任何|全部)?(的)?(指令|规则|要求|设定|提示|限制)"),
    ("指令覆盖", "high", r"(?iuU)(ignore|disregard|forget)\s+(?:\w+\s+){0,2}(instructions?|rules?|prompts?|guidelines?|constraints?)"),
    ("指令覆盖", "high", r"(?iuU)不要(遵守|执行|理会)(之前|上述|以上|任何)?(的)?(指令|规则|要求)"),
    ("越狱术语", "high", r"(?iuU)(sudo\s*mode|开发者模式|越狱模式|\bDAN\b|jailbreak)"),
    ("套取提示词", "mid", r"(?iuU)(输出|告诉我|显示|复述|打印|泄露)(你的|系统|完整|初始)?(系统)?提示词"),
    ("套取提示词", "mid", r"(?iuU)(reveal|show|print|output|repeat)\s+(your\s+)?(system\s*prompt|instructions?)"),
    ("套取提示词", "mid", r"(?iuU)(system\s*prompt|系统提示词|内部指令|你的设定)"),
    ("角色劫持", "mid", r"(?iuU)你现在(不再是|是)|从现在起你是|请扮演|角色扮演为|进入.{0,6}模式"),
]
#: Patterns whose every match has one of some words without upper or lower case, so that texts without them needn't be searched.
INJECTION_PARTS = {
    INJECTIONS[0][2]: ["忽略"],
    INJECTIONS[2][2]: ["不要"],
    INJECTIONS[4][2]: ["提示词"],
    INJECTIONS[7][2]: ["你现在", "从现在起你是", "请扮演", "角色扮演为", "进入"],
}
FILTERED_SENTENCE = "【⚠️ 检测到疑似注入指令，该句已过滤】"

#: Document types by keyword, in order of priority; without one a document is knowledge.
DOCUMENT_TYPES = {
    "policy": ["政策", "法规", "条例", "规定", "办法", "通知", "公告", "管理", "实施细则"],
    "data": ["数据", "报告", "统计", "分析", "榜单", "排名", "财报", "业绩"],
    "tech": ["教程", "指南", "手册", "API", "文档", "说明"],
}

#: Advice below the warning of a stale document: beside its text, and among the hits of a search.
STALE_ADVICE = "\n\n💡 系统建议：由于文档已过期，已自动尝试联网搜索最新信息（见下方）"
STALE_HIT_ADVICE = "\n\n💡 系统建议：文档已过期，建议上传最新文档或联网搜索核实（工具会自动尝试）"
STALE_HITS_NOTE = "⚠️ 重要提示：上述内容来自过期文档，请务必调用 web_search 工具核实最新信息"

#: The reply where no data was found.
NO_DATE = "该日期"
NO_DATA_REASONS = ["该数据可能尚未公开发布", "该日期可能是非工作日或特殊时期，数据发布延迟", "搜索引擎尚未收录该时间点的数据报告"]
NO_DATA_REPORTS = "- 搜索第三方分析报告或行业研报（可能包含该时期数据）"
NO_DATA_HELP = [
    "\n**我可以帮您：**",
    "- 如果您有相关报告文档，可上传到知识库后，我能帮您提取和分析数据",
    "- 可以为您解释该类数据的计算方法和行业标准",
]

#: Dates in questions, most precise first.
DATES = [r"\d{4}年\d{1,2}月\d{1,2}[日号]", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}/\d{1,2}/\d{1,2}", r"\d{1,2}月\d{1,2}[日号]", r"\d{4}年\d{1,2}月"]
DATA_WORDS = [
    "票房", "销量", "营收", "利润", "市值", "估值", "融资", "股价", "涨跌", "用户数", "活跃用户", "DAU", "MAU", "转化率", "留存率", "点击率", "曝光", "互动量", "点赞", "评论", "转发", "播放量",
    "阅读量", "下载量", "排名", "榜单", "第几名", "热搜", "热度", "TOP", "发布", "上线", "宣布", "公布", "报道", "消息", "新闻",
]
TIME_WORDS = [
    "今天", "今日", "昨天", "前天", "明天", "后天", "今年", "去年", "明年", "本年", "上年", "本月", "上月", "这个月", "上个月", "本周", "上周", "这周", "上周", "当前", "现在", "目前", "此刻", "最新",
    "最近", "近期", "近日", "刚刚", "刚才", "实时", "即时", "最新版", "新版", "热点", "热门", "爆火", "火爆",
]

#: Topics whose answers age, with the confidence of each, then topics whose answers don't.
TIMELY_TOPICS = {
    "policy": (0.9, [
        "政策", "法规", "条例", "规定", "办法", "通知", "许可", "申请", "审批", "禁止", "允许", "限制", "管理", "要求", "标准", "流程", "手续", "证件", "禁渔", "开放", "关闭", "封闭", "管制",
    ]),
    "permission": (0.85, [
        "能不能", "可以吗", "允许吗", "能否", "是否可以", "能去", "能钓", "能做", "能用", "能办",
    ]),
    "current_state": (0.85, [
        "哪里", "在哪", "什么地方", "哪个区域", "开没开", "开了吗", "营业吗", "开放吗", "现在", "目前", "当前", "如今",
    ]),
    "data": (0.8, [
        "数据", "统计", "报告", "排名", "榜单", "票房", "销量", "股价", "市值", "营收", "用户数", "转化率", "增长率", "占比",
    ]),
}
TIMELESS_TOPICS = {
    "knowledge": [
        "什么是", "是什么", "定义", "概念", "原理", "介绍", "解释", "说明", "讲解",
    ],
    "history": [
        "历史", "由来", "起源", "发展史", "过去", "曾经", "以前", "当时",
    ],
    "tech": [
        "怎么做", "如何", "方法", "步骤", "教程", "代码", "实现", "配置", "安装",
    ],
}
PLACE_ACTIVITY = r"(天津|北京|上海|深圳|广州|杭州|成都|武汉|[省市区县])\s*(钓鱼|滑雪|露营|徒步|登山|游泳|野餐)"

MEME = r"(什么梗|啥梗|是什么梗|啥意思|什么意思|什么典故|出处|哪来的|咋来的|什么来头)"
AMBIGUITY = r"(\d+\.\d+\s+(vs|和|对比|比较|哪个大|哪个小|谁大|谁小)|(它|这个|那个|这些|那些)[\s是的有])"
FOLLOW_UP = r"(它的?|这个|那个|这些|那些|哪[个种]|上述|前面|之前|刚才|上面|第[一二三四五六七八九十\d]+[个条点步])"
SHORT_QUESTION = 12
CITED_SOURCE = r"\[来源: ([^\]·\n]+?\.(?:md|pdf|docx|xlsx|txt|png|jpg|jpeg|webp))"

#: Replacements, in order, that make Markdown speakable.
SPEECH = [(r"```[\s\S]*?```", " 代码块略。"), (r"\[来源:[^\]\n]*\]", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[#*`>|]", ""), (r"!\[[^\]]*\]", ""), (r"\n+", "。")]
SPEECH_LIMIT = 500

#: Warnings of a document's age, with the year and the age in the braces.
FROM_YEAR = "该文档来自 {year} 年（距今 {age} 年）"
NO_YEAR_WARNING = "⚠️ 文档未标注年份，无法判断时效性"
AGE_3_WARNING = "⚠️ 严重过期：{from_year}，信息可能已失效"
AGE_2_WARNING = "⚠️ 数据过期：{from_year}，建议核实最新信息"
AGE_1_DATED_WARNING = "⚠️ 可能过期：{from_year}，政策/数据可能已更新"
AGE_1_WARNING = "💡 文档来自 {year} 年（距今 {age} 年）"
RECENT_NOTE = "✓ 文档来自 {year} 年（较新）"

#: Further parts of the reply where no data was found, with what they name in the braces.
NO_DATA_SEARCHED = "抱歉，我已尝试联网搜索，但未能找到关于**{date}**的具体{named}数据。"
NO_DATA_UNSEARCHED = "抱歉，由于联网搜索暂时不可用，无法获取**{date}**的实时数据。"
NO_DATA_FUTURE = "您询问的是未来时间（{date}），该数据尚不存在"
NO_DATA_MONTH = "- 尝试查询整个**{month}月**的数据"
NO_DATA_YEAR = "- 查看**{year}年度**的总体数据"
NO_DATA_OFFICIAL = "- 访问官方平台或专业数据网站查询{type}"
NO_DATA_WHY = "\n**可能的原因：**"
NO_DATA_INSTEAD = "\n**替代建议：**"
