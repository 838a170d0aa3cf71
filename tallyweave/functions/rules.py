"""Rule tables of the payroll domain, as data."""

#: Duty-allowance codes of managers and of class teachers.
MANAGER_CODES, TEACHER_CODES = ("C1009", "C1001"), ("C1014",)
#: The four compared measures and their labels, in the order in which differences are listed.
MEASURES = ("pay", "prof", "mgr", "tutor")
MEASURE_LABELS = {"pay": "薪俸／本俸", "prof": "專業加給／學術研究費", "mgr": "職務加給", "tutor": "導師加給＋特教加給"}
#: Labels in registers and the fields that they stand for.
FIELD_ALIASES = {
    "本俸": "pay", "薪俸": "pay",
    "專業加給": "prof", "學術研究": "prof", "學術研究費": "prof",
    "職務加給": "mgr", "主管加給": "mgr",
    "導師加給": "_tutor", "導師費": "_tutor",
    "特教加給": "_special",
    "地域加給": "region",
    "應發數合計": "gross", "應發金額": "gross",
    "實發數": "net", "實發金額": "net",
}
#: Words that mark rows of sums and signatures.
SKIP_NAMES = ("小計", "合計", "總計", "備註", "出納", "人事", "會計", "製表")
#: Departments by title. The order breaks ties.
TITLE_DEPARTMENTS = {
    "校長": "校長室",
    "教務主任": "教務處", "教學組長": "教務處", "註冊組長": "教務處",
    "設備組長": "教務處", "資訊組長": "教務處", "教務組長": "教務處",
    "學務主任": "學生事務處", "訓導主任": "學生事務處", "訓育組長": "學生事務處",
    "生教組長": "學生事務處", "生活教育組長": "學生事務處", "體育組長": "學生事務處",
    "衛生組長": "學生事務處", "訓導組長": "學生事務處",
    "總務主任": "總務處", "事務組長": "總務處", "出納組長": "總務處", "文書組長": "總務處",
    "輔導主任": "輔導室", "輔導組長": "輔導室", "資料組長": "輔導室", "特教組長": "輔導室",
    "教導主任": "教導處", "人事主任": "人事室", "人事管理員": "人事室",
    "會計主任": "會計室", "主計": "會計室",
    "校護": "健康中心", "護理師": "健康中心",
    "工友": "總務處", "技工": "總務處", "駕駛": "總務處",
}
#: Other names of departments.
DEPARTMENT_ALIASES = {"訓導處": "學生事務處", "學務處": "學生事務處", "輔導處": "輔導室", "學生輔導室": "輔導室"}
#: Words taken out of a department's name, one after another.
DEPARTMENT_WORDS = ("處", "室", "中心")
#: Title words excluded by default (the first hit is reported) and those of formal posts.
EXCLUDED_TITLES = ("代理", "代課", "長代", "教保員", "助理教保", "約僱", "約聘", "臨時", "工讀", "替代役", "實習", "志工")
FORMAL_TITLES = ("校長", "主任", "組長", "教師", "導師", "科任", "幹事", "書記", "護理師", "校護", "工友", "技工", "駕駛", "教練", "職員", "管理員")
#: Output columns of the short sheets, and the numeric ones.
SHORT_COLUMNS = ("清冊序號", "姓名", "薪俸表別", "總金額", "支領數額", "專業加給表別", "總金額.1", "支領數額.1", "職務加給表別", "總金額.2", "支領數額.2")
REGION_COLUMNS = (*SHORT_COLUMNS, "地域加給表別", "總金額.3", "支領數額.3")
NUMERIC_COLUMNS = ("清冊序號", "增支", *[f"{c}{s}" for s in ("", ".1", ".2", ".3") for c in ("總金額", "支領數額", "待遇差額", "補發金額")])
#: A register's layout as shown.
LAYOUT_LABELS = {"vertical": "直式（一人一欄）", "horizontal": "橫式（一人一列）"}
#: What a match rests on, from the surest to the weakest; 單位 is followed by the department that the title gives.
BASIS_ID, BASIS_NAME, BASIS_DEPT, BASIS_FLAG, BASIS_AMOUNTS, BASIS_LEFT = "身分證字號", "姓名", "單位", "主管職", "金額指紋", "順推"
BASIS_NEAR = "姓名相近（AF 為「{}」，請確認是否同一人）"
#: Texts of the warnings; the names follow, or stand at the braces.
WARN_MISSING = "清冊中以下人員在 AF 找不到對應："
WARN_EXTRA = "AF 中以下人員不在清冊內，已附加至末尾："
WARN_TWICE = "清冊中以下姓名出現多次，請確認是重複登打或同名不同人："
WARN_CODE = "AF 出現未知職務加給代碼 {}（{}），未納入比對"
WARN_NAMESAKES = "AF 有 {} 位同名「{}」，將以職稱／單位區辨"
WARN_SUMS = "薪資清冊本身加總不符（各項相加 ≠ 應發金額）：{}，請先確認清冊是否正確"
#: The order of outcomes.
STATUS_ORDER = ("diff", "pdf_only", "af_only", "ok")
#: Thresholds of learning and matching.
MIN_PEOPLE, MIN_FILES, MATCH_CUTOFF, NAME_CUTOFF, LOW_CONFIDENCE = 3, 2, 0.75, 0.5, 0.5
#: Seconds of the job queue.
JOB_TTL, JOB_TIMEOUT, ACTIVE_WINDOW, POLL_ACTIVE, POLL_IDLE = 600, 120, 600, 3, 60
