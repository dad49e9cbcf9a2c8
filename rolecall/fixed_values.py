"""Word lists, lookup tables, formats and texts the results depend on.

Everything here is data. The rules that use it live in the operator modules.
"""

# Placeholders and markers.
NO_DETAIL = "상세 내용 없음"
NO_CONTENT = "해당 내용 없음"
SENTENCE_TYPES = ("title", "required", "preferred")
EMBEDDING_WIDTH = 1536
RETRIEVAL_COUNT = 10
RERANK_COUNT = 10
MODEL_TRIES = 3
MODEL_WAIT_SECONDS = 1.0
RESUME_MIN_CHARS = 20
RESUME_MAX_CHARS = 1000
STALE_AFTER_DAYS = 1
WEEK_DAYS = 7
DAY_DAYS = 1

# Characters that count as white space at both ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Labels of the sections joined into one detail text.
DETAIL_LABELS = ("조직소개", "업무내용", "지원자격", "채용절차")

# Title words.
TITLE_KEYWORDS = ("engineer", "developer", "scientist")
TITLE_KEYWORDS_KO = ("개발자", "엔지니어", "과학자")
INCLUDE_WORDS = ("Engineer", "Developer", "Scientist", "Research", "Director", "Architect")
EXCLUDE_PHRASES = ("UX Research", "Product Management", "Product Design", "Marketing")
EXCLUDED_AFFILIATE = "쿠팡풀필먼트서비스"

# Sources: company name and the other names it goes by.
SOURCES = {
    "naver": ("네이버", ("naver",)),
    "kakao": ("카카오", ("kakao",)),
    "line": ("라인플러스", ("lineplus", "line plus", "라인 플러스")),
    "coupang": ("쿠팡", ("coupang",)),
    "baemin": ("우아한형제들", ("배달의민족", "woowa", "배민", "baemin")),
    "daangn": ("당근", ("daangn",)),
    "hpcnt": ("하이퍼커넥트", ("hyperconnect", "hpcnt")),
    "devsisters": ("데브시스터즈", ("devsisters",)),
    "flipster": ("플립스터", ("flipster",)),
    "hyperithm": ("하이퍼리즘", ("hyperithm",)),
}

# Posting links; {id} is the source's own id, {path} the link found in the page.
LINKS = {
    "naver": "https://recruit.navercorp.com/rcrt/view.do?annoId={id}&lang=ko",
    "kakao": "https://careers.kakao.com/jobs/{id}",
    "line": "https://careers.linecorp.com{path}",
    "coupang": "https://www.coupang.jobs{path}",
    "baemin": "https://career.woowahan.com/recruitment/{id}/detail",
    "daangn": "https://about.daangn.com{path}",
    "hpcnt": "https://career.hyperconnect.com/job/{id}",
    "devsisters": "https://careers.devsisters.com/o/{id}",
    "flipster": "https://careers.flipster.io/jobs/{id}",
    "hyperithm": "https://hyperithm.career.greetinghr.com/ko/o/{id}",
}
BAEMIN_FETCH_LINK = "https://career.woowahan.com/w1/recruits/{id}"

# Where the detail text sits: element, class, id.
DETAIL_ELEMENTS = {
    "naver": ("div", "detail_wrap", None),
    "line": ("section", None, "jobs-contents"),
    "coupang": ("article", "cms-content", None),
    "daangn": ("article", "c-kJtTwH", None),
    "hpcnt": ("div", "css-6uaq7a", None),
    "devsisters": ("div", "detail", None),
    "flipster": ("div", "styles_lever_content__ql2gg", None),
    "hyperithm": ("div", "ql-editor", None),
}
DETAIL_PLACEHOLDER_SOURCES = ("naver", "line", "baemin", "devsisters")

# Affiliate spellings (lower case) and the names they stand for.
NAVER_ALIASES = {
    "naver": "네이버",
    "naver cloud": "네이버클라우드",
    "naver labs": "네이버랩스",
}
COUPANG_ALIASES = {
    "coupang": "쿠팡",
    "coupang pay": "쿠팡페이",
    "search & discovery": "쿠팡",
    "coupang fulfillment services": "쿠팡풀필먼트서비스",
    "coupang play": "쿠팡플레이",
}

# Title suffixes and the affiliate each one names, in the order they apply.
COUPANG_SUFFIXES = (
    (" — Coupang Play", "쿠팡플레이"),
    (" - Coupang Play", "쿠팡플레이"),
    (" (Coupang Play)", "쿠팡플레이"),
    (" — Coupang Pay", "쿠팡페이"),
    (" - Coupang Pay", "쿠팡페이"),
)
COUPANG_WORD = ("Eats", "쿠팡이츠")

# Tag names in the order they are seeded.
TAG_NAMES = (
    "AI", "SRE", "BE", "FE", "보안", "SE", "NE", "DE", "앱", "QA", "DA", "DB", "DevOps", "게임", "PM", "XR",
    "블록체인",
)

# Tag rules in output order: tag, title words (lower case), and title words that
# count for one company only.
TAG_RULES = (
    ("게임", (), (("데브시스터즈", "클라이언트"),)),
    ("블록체인", ("cef", "defi", "blockchain", "블록체인"), ()),
    (
        "AI",
        (
            "ai ", "machine learning", "deep learning", "머신러닝", "딥러닝", "rpa", "추천", "computer vision",
            "data scien", "ml", "데이터과학자", "senior staff engineer, growth engineering", "llm", "hyperclova",
            "ai엔지니어", "director of training and quality",
        ),
        (("하이퍼리즘", "소프트웨어 엔지니어 (인턴십)"),),
    ),
    ("SRE", ("sre", "reliability"), ()),
    (
        "BE",
        (
            "back-end", "백엔드", "backend", "back end", "be ", "be개발", "플랫폼 개발", "서버 개발", "서버개발",
            "server engineer", "서버 소프트웨어", "plus 채용연계형 인턴십", "head of engineering",
            "platform engineer", "서버 엔지니어", "사내정보시스템 개발", "금융 플랫폼", "api gateway",
        ),
        (("쿠팡", "staff software engineer"),),
    ),
    (
        "FE",
        (
            "front-end", "프론트", "frontend", "front end", "도구개발팀 시니어 엔지니어", "웹 개발",
            "호텔 서비스 개발", "web engineer", "naver 개인화 서비스 개발", "fe 개발", "web app",
        ),
        (),
    ),
    ("보안", ("security", "보안 ", "red team", "soar", "개인정보보호 관리", "compliance"), ()),
    (
        "SE",
        (
            "systems engineer", "system engineer", "시스템 엔지니어", "data center", "system developer",
            "systems developer", "firmware", "robotics", "robot os", "industrial engineer",
            "object storage 서비스 개발", "facility design", "시스템 소프트웨어", "engineer global operation",
        ),
        (),
    ),
    ("NE", ("network engineer", "네트워크 엔지니어", "인프라 엔지니어(network", "전기통신"), ()),
    (
        "DE",
        (
            "data engineer", "engineer, data", "bi engineer", "데이터엔지니어", "데이터 엔지니어",
            "data warehouse", "data pipeline", "data platform", "software engineer (data)",
            "analytics engineer", "분산 시스템", "데이터 서빙",
        ),
        (),
    ),
    (
        "앱",
        (
            "안드로이드", "ios", "react native", "flutter", "mobile", "android",
            "지도기반 슈퍼앱 서비스 개발 (경력)",
        ),
        (),
    ),
    ("QA", ("qa", "test engineer", "test automation"), ()),
    ("DA", ("데이터분석", "data analyst"), ()),
    ("DB", ("db ", "데이터베이스", "hbase ", "dba", "sap "), ()),
    (
        "DevOps",
        (
            "kubernetes", "devops", "cloud ", "engineer, infra", "인프라운영", "cloud iaas", "클라우드 플랫폼",
            "cloud & infrastructure", "cloud storage", "데브옵스",
        ),
        (),
    ),
    (
        "PM",
        (
            "program manage", "project manage", "product manage", "partner manage", "asset manage",
            "director product", "지원 담당", "관리 전문", "director, procurement", "relations manager",
            "relation manager", "it기획", "acquisition", "product compliance", "협력 담당자",
        ),
        (),
    ),
    ("XR", ("xr", "vr", "augmented reality", "virtual reality", "모션", "motion", "graphics"), ()),
)

# Texts put around the data in the prompt datasets; {…} marks where data goes.
SUMMARY_SYSTEM_TEXT = """
아래 이력서를 읽고 지원자의 경력의 순서를 명시하고, 지원자가 가진 능력을 한 줄 씩 적어주세요.
경력 기준 가장 강한 능력으로 보이는 것을 먼저 적어주세요.

출력 형식:
- "->"로 구분된 학력/경력
- 능력 1
- 능력 2
- 능력 3
...

출력 예시:
- 카이스트 학부 -> 크래프톤 (프론트엔드 엔지니어) -> 토스 (DevOps 엔지니어)
- Java 및 Spring Framework 활용 개발 경험 및 AWS 환경 경험
- React, Vue 등 최신 프론트엔드 프레임워크 및 유형 컴포넌트 UI 설계 경험
- 광고 및 이커머스 도메인 경험
- MLOps와 LLMOps 파이프라인 구현 및 관리
- Kubernetes 등 컨테이너 오케스트레이션 시스템 활용 운영 경험
- 대화형 AI, 음성인식, NLP 등 AI/ML 관련 솔루션 실무 경험
"""

RERANK_JOB_TEXT = (
    "공고번호 {job_idx}. {job_title} ({company_name})\n"
    "  - 팀 소개: {team_info}\n"
    "  - 담당업무:\n    {responsibilities}\n"
    "  - 지원자격:\n    {qualifications}\n"
    "  - 우대사항:\n    {preferred_qualifications}"
)
PROMPT_LIST_SEPARATOR = "\n    "
PROMPT_JOB_SEPARATOR = "\n\n"

RERANK_TEXT = """
다음은 당신이 가진 채용공고의 리스트입니다.
당신은 이 채용공고 중 지원자가 적합한 {rerank_count}개의 공고를 선별하고 적합한 순으로 정렬하고 설명을 첨부해야 합니다.
적합한 이유는 100자 이내로 명시해야 합니다.
지원자의 이름은 언급하지 않고 지원자라고 표현해야 합니다.

이력서는 다음과 같습니다.
===이력서 (정제되지 않은 텍스트)
{resume_text}


===채용공고 리스트
{job_list}


===출력 형식
"공고번호" (key: job_idx)
"공고이름" (key: job_title)
"적합한 이유" (key: reason)

{ "results": [{ "job_idx": "...", "job_title": "...", "reason": "..." }, ...] }
"""

COVER_LETTER_TEXT = """
당신은 IT회사의 지원자입니다.
당신은 아래 주어진 이력서를 바탕으로 주어진 채용공고에 지원하려 합니다.
회사의 문화를 고려하여 알맞은 커버레터를 작성해 주세요.

당신의 이력서는 다음과 같습니다.
===이력서 (정제되지 않은 텍스트)
{resume_text}


===채용공고
- 공고 이름: {job_title}
- 회사 이름: {company_name}
- 팀 소개: {team_info}
- 담당업무:
    {responsibilities}
- 지원자격:
    {qualifications}
- 우대사항:
    {preferred_qualifications}


===주의사항
- 문어체로 작성할 것
- 지원자의 이름은 언급하지 않을 것
- 아래 4개의 문단 외에 글을 작성하지 말 것, 인삿말도 작성하지 말 것
- 문단 1. 본인 소개, 지원동기, 지원직무 언급
- 문단 2. 업무경력, 성과, 본인의 핵심역량 어필
- 문단 3. 입사 포부
- 문단 4. 인터뷰 기회 요청으로 마무리
"""

EXTRACTION_TEXT = """
당신은 친절한 헤드헌터입니다.
다음은 '{company_name}' 회사의 개발자 채용 공고 상세 내용 원본 텍스트입니다:

```text
{detail}
```

작업 목표:
주어진 원본 텍스트에서 구조화된 정보를 추출하고, 아래 설명된 '토스(Toss) 글쓰기 5가지 원칙' 에 따라 각 항목의 내용을 재작성하여 지정된 JSON 형식으로 반환합니다. 최종 결과물은 지원자가 쉽고 명확하게 이해하며, 친근하고 존중받는 느낌을 받도록 작성되어야 합니다.

재작성 시 적용할 '토스 글쓰기 5가지 원칙':

명확하게: 쉽고 명확한 단어/문장 사용. 사용자 입장에서 이해하기 쉽게 작성. 모호함 제거.
간결하게: 핵심만 간결하게 전달. 불필요한 내용 제거. 빠르게 훑어볼 수 있도록 구성. (예: 주요 목록은 불렛포인트 활용)
친근하게: 부드럽고 친근한 어조 사용 (~해요). 어려운 전문 용어 대신 쉬운 표현 사용.
존중하며: 솔직하고 투명하게 정보 전달. 과장 없이. 지원자를 존중하는 태도 유지.
공감하며: 긍정적/공감적 언어 사용. 팀/성장의 매력 전달 (단, 명확/정직함 우선).

작업 단계:

1. 원본 텍스트에서 다음 항목들에 해당하는 핵심 정보를 정확하게 추출합니다:

"팀 소개" (key: team_info)
"담당업무" (key: responsibilities)
"지원자격" (key: qualifications)
"우대사항" (key: preferred_qualifications)
"채용프로세스" (key: hiring_process)
"추가사항" (key: additional_info)

2. 추출된 각 항목의 내용을 위에 요약된 '토스 글쓰기 5가지 원칙'을 종합적으로 고려하여 새롭게 재작성합니다.

- 원본 텍스트의 문장을 그대로 가져오지 않고, 원칙에 맞춰 의미는 유지하되 표현 방식을 완전히 바꾼다는 생각으로 다시 작성해주세요.
- 당신은 회사가 아닙니다. '저희', '우리 회사' 같은 회사를 자칭하는 말은 사용하지 않고, 회사의 이름을 명시해주세요.
- 채용공고가 사용하는 화살표, >, 괄호 등의 표시는 사용하지 않습니다.
- 공고 전체가 영어로 쓰여졌을 경우, 한글로 재작성합니다.
- 매우 중요: 담당업무, 지원자격, 우대사항, 채용프로세스, 추가사항은 리스트로 응답합니다.

3. 2단계에서 재작성된 내용만을 사용하여, JSON 형식으로 최종 결과를 반환합니다.

출력 형식 및 예외 처리:
- 만약 특정 항목에 대한 내용을 원본 텍스트에서 찾을 수 없다면, 해당 JSON key의 값으로 "해당 내용 없음"을 사용해주세요.
- JSON 객체 외에 다른 부가적인 설명, 인사말, 코드 블록 마커(```json ... ```) 등은 절대 포함하지 마세요. 오직 순수한 JSON 객체만 출력해야 합니다.
"""
