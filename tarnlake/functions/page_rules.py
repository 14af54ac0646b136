"""Rule tables for pages and their urls: patterns, word lists and weights. Fixed values, which results depend on. All patterns are searched in any case."""

from __future__ import annotations

# Titles and paths of pages that are no programme.
JUNK_TITLE = (
    r"cookie|cookies|privacy|accessibility|homepage|navigation|404|not found|403|forbidden|access denied|just a moment|cloudflare|^programmes?$|^programs?$|"
    r"^all programmes?$|^masters?$|^bachelors?$|^all (?:our )?master.?s programmes?$|^alle masteropleidingen$|^master.?s degrees a to z$|^find your master$|"
    r"^find master'?s programme$|^find your study program!?$|^find study program$|^study programme finder$|^find your programme$|^all study programmes?$|"
    r"^other study programmes?$|^open programmes?$|^short programmes?$|^courses and programmes$|^projects & programmes$|^discover our programmes$|"
    r"^postgraduate diploma programmes and fellowships$|^specialising master programmes$|^programmes in english$|^international programmes$|"
    r"^major programmes?$|^programme specialisations$|^work-integrated master.?s degree programmes$|^universitary master.?s degrees by areas of knowledge$|"
    r"^overview of ceu degree programs$|^overview \(pre\)master'?s programmes$|^study programmes and course catalogue$|^range of study programmes$|"
    r"^degree programmes a-z$|^degree programmes held in english$|^english-language degree programmes at luh$|^master'?s courses in \d{4}-\d{4}$|"
    r"^master.?s programs?$|^master programs?$|^master.?s degree studies$|^master'?s programs .*university$|^master programs in (?:english|german)\b|"
    r"^master'?s degree programs\. programs of study\.|^masters degree - programmes$|^master.?s degree programmes taught in italian$|"
    r"^degree programmes with study start in february$|^first and second cycle degree programmes$|^double degree programmes$|^changing degree programmes$|"
    r"^degree programs at graduate school$|^all programs offered at tu berlin$|^professional master.?s degree programs$|^professional master'?s programmes$|"
    r"^extended master'?s programs$|^research master'?s programs$|^interuniversity master programmes: a\.y\. \d{4}/\d{4}$|"
    r"^postgraduate and other programmes$|^other educational programmes$|^continuing education and teacher training programmes$|"
    r"^capacity development programmes$|^funding programmes according to career level$|^dfg programs$|^bsc programmes$|^department of\b|^faculty of\b|"
    r"^executive master.?s$|list of master'?s programmes?|master.?s programmes taught in english|erasmus mundus and master.?s degrees in english|"
    r"new opportunities (?:to earn (?:a )?|for )?master.?s degrees?|^study programmes?$|^degree programmes?$|^graduate programmes?$|: study programmes?$|"
    r"^academic programmes?$|^teacher training programmes?$|^degree programmes at\b|^international degree programmes at\b|"
    r"^overview: (?:degree and certificate|teacher education) programme|^international study programmes?$|admission requirements?|application procedure|"
    r"how (?:and when )?to apply|tuition fees?|applications for german nationals, holders of german entrance qualification|entry requirements?|open day|"
    r"prepare for your studies|exchange programmes?|exchange programs?|study abroad programmes?|summer institute programs|seasonal schools organized at|"
    r"^lifelong learning$|lmu buddy program|summer semester \d{4}|^master.?s diplomas$|^research networks$|^didactic fellowship programme$|"
    r"continuing education programme for early career researchers|scholarship programmes?|large-scale programmes?|scholarships? database|"
    r"university diplomas?|specialised medical programmes?|pre-master'?s?(?: programmes?| and minors)?|\bwebinars?\b|graduation ceremony|\banniversary\b|"
    r"^idex programs?$|^les programmes europ(?:e|é)ens de recherche$|^chef d[ '’]?equipe$|^polydaire$|^eco marathon shell$|^stages?$|^current students?$|"
    r"^moving to france$|^sponsorship$|^uli\.ge$|^culture and sport team up at unipd$|^freie universit.t berlin$|^further information$|"
    r"^oferta de m.sters oficials$"
)
INFO_PAGE_TITLE = (
    r"^admissions?$|graduate international admissions|admissions? overview|master['’]?\s*:\s*admission|master'?s admissions?[: ](?:process|test|deadlines)|"
    r"master'?s admission$|master'?s admissions?: deadlines|applications? and admissions? for masters?|results of the admission procedures|"
    r"eligibility criteria|eligibility requirements?|language requirements?|proof of .*language requirements?|cv form instructions|required documents|"
    r"requirements for admission|^master.?s degree\s*-\s*required documents$|^master'?s requirements$|^apply to master'?s$|^selection process master'?s$|"
    r"^online application$|^the online application:.*|^application master$|^enrollment master'?s$|^application guide$|^application$|"
    r"^application via uni-assist$|^course selection$|^calls for applications, regulations and ranking lists$|^apply for the winter semester!?$|"
    r"^applying to .*master.?s programmes$|^apply to international master'?s programmes$|^enrollment in master.?s programs$|"
    r"^enrolment process for admitted master students\b|^enrolment in two different university degree programmes$|^apply online!.*|^course selection$|"
    r"^stay informed: master'?s application$|^immunization requirements$|^international educational background$|"
    r"^information for international prospective students for medicine and dentistry$|^medicine and dentistry \(eu, eec et al\.\)$|^admission department$|"
    r"^selection procedures$|selection criteria|^important dates and deadlines$|^results and enrollment(?: - ay \d{4}-\d{2})?$|application deadlines|"
    r"financial aid|statistical data on master programmes with selection procedure|"
    r"^deadlines? / closing dates for applications for the master.?s programmes$|application and admission to (?:a )?master'?s degree program|"
    r"apply to a master.?s programme at .+|application to the master'?s degree programmes|application for master.?s degree programs|"
    r"master.?s program application|guide to applying for a master'?s degree program|applicants with (?:a |an )?(?:non-italian|italian) qualification|"
    r"application process for applicants with a citizenship|apply for a program or course in the second application round|"
    r"apply and enrol with an italian entry title|application of information from master'?s degree|"
    r"call for grant applications for attracting talent to masters courses|application for teacher training/master of education|"
    r"applying for admission to an advanced semester|applying for a master.?s degree program as an international student|"
    r"admission to the first subject-specific semester|admission to (?:the )?(?:medicine and dentistry|master'?s program)|"
    r"two-years master.?s programmes admissions|two-year master.?s programmes .*: (?:deadlines|selection criteria)|"
    r"admission to master of science programmes|admission to master'?s degree programmes|study orientation|buddy programme|scholarships?|"
    r"full degree mobility faq|short-term blended mobility|pre-study orientation program|^application for international students$|"
    r"^enrolment for international students$|^required documents for international students$|^country-specific requirements$"
)
NON_MASTER_TITLE = r"\b(?:bachelor|undergraduate|doctoral|doctorate|ph\.?d\.?)\b"
BLOCKED_PATH = (
    r"/(?:research|recherche|innovation|news|actualites?|articles?|events?|webinars?|admissions?|application|application-registration|exchange|"
    r"scholarships?|information-activities|how-to-register|master-theses|mobility-programmes|incoming-students|tuition-fees?|fees-and-funding|"
    r"moving-to-france|current-students(?:-\d+)?|administrative-procedures|health-insurance(?:-\d+)?|banks-insurances|accommodation|sponsorship)(?:/|$)"
)
BLOCKED_PATH_FRAGMENT = r"(?:^|/)(?:webinar-|.*-webinar-|.*graduation-ceremony.*|.*-anniversary(?:-|/|$)|open-day(?:-|/|$))"

# Titles that programme lists leave out.
LIST_NOISE = (
    r"^(list of|browse|how to apply|entry requirement|scholarship|ask us|info day|fellowship|master.s (programs|studies|programmes)|range of degree|"
    r"bachelor|doctoral|diploma|new degree|study at|study options|frequently asked|admission services|apply to bachelor|programmes$|programs$|"
    r"admission to master|key skill|didactic|lifelong learning|master.s degree studies|master.s programmes in |browse master.s)"
)
LIST_NOISE_ANY = r"doctoral|\bph\.?d\b|bachelor of science and master|bachelor of business"

# Titles that the assembled store leaves out.
STORE_JUNK_TITLE = (
    r"cookie|cookies|cookie\s*(管理|panel|面板)|homepage|navigation|further information|accessibility\s*setting|all areas|^students?$|admis\s*sion\s*depart|"
    r"该网页无法正常运作|le site utilise des cookies|ce site utilise des cookies|this website uses cookies|404|search$|^suche$|^search\s*$|^74$|"
    r"^master.?s degree programmes?$|^master.?s programmes?$|^master.?s$|^programmes?$|^programs?$|^all programmes?$|^courses?$|^masters?$|^bachelors?$|"
    r"^study programmes?$|^degree programmes?$|^graduate programmes?$|open day|prepare for your studies|admission requirements?|application procedure|"
    r"how (and when )?to apply|tuition fees?|entry requirements?|film festival|news|event\b|open day|webinar|summer school|graduation ceremony|"
    r"\banniversary\b|^idex programs?$|^les programmes europ(?:e|é)ens de recherche$|^chef d[ '’]?equipe$|^polydaire$|^eco marathon shell$|^stages?$"
)

# What official programme urls and captured pages are accepted by.
URL_SPECIFIC = (
    r"(?:\bmaster(?:s)?\b|\bpostgraduate\b|\bgraduate\b|\bgrad(?:uate)?[-_ ]?school\b|\bm\.sc\b|\bmsc\b|\bdegree(?:s)?\b|\bprogram(?:me)?s?\b|"
    r"\bcourse(?:s)?\b|\bcurriculum\b|\bcatalog\b)"
)
URL_GRADUATE_LEVEL = r"(?:\bmaster(?:s)?\b|\bpostgraduate\b|\bgraduate\b|\bgrad[-_ ]?school\b|\bm\.sc\b|\bmsc\b)"
URL_CATALOG_SIGNAL = r"(?:\bdegree(?:s)?\b|\bprogram(?:me)?s?\b|\bcourse(?:s)?\b|\bcurriculum\b|\bcatalog\b)"
URL_WRONG_LEVEL = r"(?:undergraduate|bachelor)"
URL_DOCTORAL_LEVEL = r"(?:\bdoctoral\b|\bdoctorate\b|\bphd\b|\bph\.d\b)"
URL_NON_MASTER_QUALIFICATION = r"(?:\b(?:graduate|postgraduate|post[-_ ]?bacc(?:alaureate)?)\b[-_/ ]*(?:certificate|diploma|minor)\b|\b(?:cert|certificates?|diplomas?|minors?)\b)"
URL_NOISE = (
    r"(?:/news(?:/|$)|/story(?:/|$)|/events?(?:/|$)|/calendar(?:/|$)|/blog(?:/|$)|/careers?(?:/|$)|/jobs?(?:/|$)|\bresearch\b|\bforschung\b|\bcalendars?\b|"
    r"free[-_ ]?speech|trustees?|privacy|accessibility|feedback|donate|alumni)"
)
URL_NON_PROGRAM_DETAIL = (
    r"(?:/(?:fees?(?:[-_/ ]funding)?|funding|tuition(?:[-_ ]fees)?|scholarships?|financial[-_ ]aid|accommodation|housing)(?:/|$)|masters?[-_ ]?thesis|"
    r"master[-_ ]?labs?|master[-_ ]?students?|oferty[-_ ]?pracy)"
)
URL_AGGREGATOR = r"(?:standyou|mastersportal|studyportals|findamasters|globalstudyprep|studyabroad|hotcourses|student\.com|wikipedia)"
APPLICATION_NOISE = r"(?:mentor(?:ing)?[-_ ]?program|graduate[-_ ]student[-_ ]life|exchange[-_ ]program|graduate[-_ ]groups?)"
APPLICATION_CATALOG_ENDPOINT = (
    r"/(?:online[-_])?(?:graduate(?:[-_ ]program(?:me)?s?)?|masters?(?:[-_ ]program(?:me)?s?)?|postgraduate(?:[-_]\d+)?|graduate[-_]english)(?:\.(?:html?|"
    r"php|aspx?))?/?$"
)
URL_POSTGRADUATE_GUIDE = r"(?:postgrad|postgraduate).*(?:guide|handbook)"
URL_CS_ENGINEERING_URL = (
    r"\b(?:computer[-_ ]science|computing|informatics|information[-_ ]technology|software|data[-_ ]science|artificial[-_ ]intelligence|machine[-_ ]learning|"
    r"cyber[-_ ]?security|robotics|engineering|electrical|electronics|mechanical|civil|chemical|biomedical|aerospace|environmental|energy|materials|"
    r"industrial|mechatronics|automation|manufacturing)\b"
)
CAPTURED_MASTER_LEVEL = r"(?:\bmaster(?:'?s)?\b|\bmsc\b|\bm\.sc\b|\bm\.?s\.?\b|\bmeng\b|\bm\.eng\b|\bpostgraduate\b|\bgraduate\b|\blaurea magistrale\b)"
CAPTURED_CATALOG_TITLE = (
    r"(?:\bmaster(?:'?s)?(?:[-\s/&]+(?:degree|study|academic|taught|coursework|professional))*[-\s/&]+(?:programmes|programs|degrees?|courses?|"
    r"catalog(?:ue)?|studies)\b|\b(?:postgraduate|graduate)(?:[-\s/&]+(?:degree|academic|taught|coursework|professional))*[-\s/&]+(?:programmes|programs|"
    r"degrees?|courses?|catalog(?:ue)?)\b|\bfind your master\b|\brange of degree programmes\b|\ba[- ]?z of postgraduate\b|\bsearch programmes and courses\b)"
)
CAPTURED_CATALOG_ENDPOINT = (
    r"(?:^(?:masters?|postgraduate|graduate)$|^(?:masters?|postgraduate|graduate)[-_](?:degree[-_])?(?:programmes?|programs?|degrees?|courses?|studies)$|"
    r"^(?:graduate[-_])?degree[-_](?:programmes?|programs?)$|^(?:programmes?|programs?)[-_](?:graduate|postgraduate|masters?)$|^(?:programmes?|"
    r"programs?)[-_]of[-_]study$|^(?:search|find)[-_](?:graduate[-_]|postgraduate[-_]|masters?[-_])?(?:programmes?|programs?|courses?)$|"
    r"^degree[-_](?:programmes?|programs?)\.(?:html?|aspx?)$)"
)
CAPTURED_PAGE_NOISE = (
    r"(?:\b(?:apply|application|admissions?|requirements?|deadline|tuition|fees?|funding|scholarships?|financial|aid|contact|faq|open[- ]?day|orientation|"
    r"language|cv form|selection procedure|thesis|student life|awards?|giving|polic(?:y|ies)|guidance|registration|register|current students?|"
    r"future students?|coming soon|time to degree|awarded|promoting excellence|accelerated|email updates?|timetables?|schedules?|advisors?|approvals?)\b|"
    r"page not found|not found|what is (?:a )?postgraduate|everything you need to know|graduate resources?|check\s*list|request information|"
    r"types? of postgraduate degrees?|wordpress at)"
)
CAPTURED_ORGANIZATION_NOISE = r"(?:\b(?:board|council|office|committee|alumni|resources?|student life)\b)"
CAPTURED_BACHELOR_LEVEL = r"(?:\bundergraduate\b|\bbachelor(?:'?s)?\b|\bb\.?sc\.?\b|\bb\.?eng\.?\b|\bb\.?a\.?\b|\bb\.?tech\.?\b|\bbs\s*/\s*ms\b)"
CAPTURED_NON_SCOPE_CATALOG = (
    r"(?:\b(?:medicine|medical|nursing|clinical|health|business|finance|law|humanities|theology|education|architecture|bioethics|professional development|"
    r"professional studies|transdisciplinary)\b|\b(?:school|faculty|department) of arts?\b(?!\s+and\s+sciences?))"
)
CAPTURED_NON_ENGINEERING_SCIENCE = r"(?:\bearth and environmental sciences?\b|\benvironmental sciences?\b|\bbiological and biomedical sciences?\b|\bbiomedical sciences?\b)"
CAPTURED_URL_NOISE = (
    r"/(?:[^/?#]*/)*(?:financial[^/?#]*|scholarships?|awards?|giving|polic(?:y|ies)|guidance|registration|current[^/?#]*students?|future[-_]students?|"
    r"coming[-_]soon|finance[-_]your[-_]masters?[-_]degree|register[^/?#]*|join[-_]us|why[-_][^/?#]+|strategic[-_]priorities|degree[-_]types|"
    r"[^/?#]*(?:timetables?|schedules?|check[-_]?list|resources?|request[-_]information)[^/?#]*)(?:\.[^/?#]+)?(?:/|$)"
)
CAPTURED_CENTRAL_SUBDOMAIN = (
    r"^(?:www|study|online|catalog|grad|graduate|graduateschool|gradschool|gradsch|gsas|rackham|sgs|pg|pgcollege|postgraduate|programs|programmes|"
    r"university)$"
)

# What links and responses are told apart by.
LINK_ASSET_PATH = r"\.(?:pdf|docx?|xlsx?|pptx?|zip|rar|7z|jpe?g|png|gif|svg|webp|ico|mp[34]|avi|mov|css|js|xml)$"
LINK_BLOCKED_TEXT = r"\b403\b|forbidden|access denied|access blocked|just a moment|cloudflare|captcha|verify you are human|incapsula|imperva"
LINK_DEGREE_WORDS = (
    r"\b(?:master(?:'s|s)?|msc|m\.sc\.?|ma\b|m\.a\.?|llm|m\.eng|meng|graduate|postgraduate|second[ -]?cycle|laurea magistrale|maestr[ií]a|m[aá]ster|"
    r"magister|masterstudium|masterstudiengang|masteropleiding|masterprogramme|masterprogram)\b"
)
LINK_PROGRAMME_WORDS = r"\b(?:programme|program|degree|course|curriculum|study option|education|formation|opleiding|studiengang|studieprogram|studies|study)\b"
LINK_CATEGORY_WORDS = r"\b(?:all|find|search|explore|list|catalog(?:ue)?|faculty|faculties|school|department|subject|discipline|field|area|filter|results?|academic)\b"
LINK_RELATED_WORDS = (
    r"admission|application|apply|deadline|entry requirements?|eligibility|language requirements?|documents?|how to apply|required documents?|"
    r"selection criteria|tuition|fees"
)
LINK_WRONG_LEVEL = r"\b(?:bachelor|undergraduate|doctoral|doctorate|ph\.?d\.?)\b"
LINK_REJECT_WORDS = (
    r"\b(?:news|events?|webinars?|open days?|summer schools?|continuing education|professional education|education for professionals|information activities|"
    r"scholarship|housing|accommodation|exchange|mobility|alumni|staff|people|vacanc|job|press|privacy|cookie|login|sign in|contact|about us|"
    r"research project|publications?)\b"
)
LINK_NON_PROGRAM_SIGNAL = r"\b(?:open days?|summer schools?|webinars?|information activities|continuing education|education for professionals|professional education)\b"
LINK_REJECT_PATH = (
    r"/(?:news|events?|webinars?|research|people|staff|jobs?|vacanc(?:y|ies)|press|privacy|cookies?|login|contact|about|alumni|housing|accommodation|"
    r"scholarships?|search|exchange|mobility|publications?)(?:/|$)"
)
LINK_CATEGORY_PATH = (
    r"/(?:study|studies|education|academic|programmes?|programs?|degrees?|courses?|curricul|masters?|graduate|postgraduate|facult(?:y|ies)|schools?|"
    r"departments?|subjects?|disciplines?|fields?|second-cycle)(?:/|$)"
)
LINK_PROGRAM_PATH = (
    r"/(?:programmes?|programs?|degrees?|courses?|curricul(?:um|a)|study-programmes?|study-programs?|masters?|master-degree|second-cycle|"
    r"laurea-magistrale)(?:/[^/?#]+){1,}"
)
LINK_OPAQUE_PROGRAM_PATH = (
    r"(?:/program\d+\.html$|/course_of_study/[^/?#]+$|/oferta-de-masteres/[^/?#]+$|/estudio/ver$|/ProgramHakkinda\.php$|/program_detay\.php$|"
    r"/lisansustu-programlari/\d+$|/lisans-ustu-programlar/\d+$|/course/[^/?#]+$|/degree-program/[^/?#]+$|/studiengaenge/[^/?#]+-master$)"
)
LINK_PAGINATION_TEXT = r"^(?:next|previous|prev|older|newer|more|load more|show more|view more|\d{1,3}|[>»›→]+)$"
LINK_PAGINATION_QUERY = r"^(?:page|p|offset|start|pageNumber|page_num)$"
LINK_GENERIC_CATEGORY = (
    r"/(?:en|fr|de|it|es|pt|nl|sv|da|fi|no)?/?(?:study|studies|education|programmes?|programs?|courses?|degrees?|masters?|graduate|postgraduate|faculties|"
    r"schools?)?/?$"
)

# Terms of the two disciplines in scope.
CS_TERMS = (
    r"\b(?:computer science|computing|informatics|information technology|software|data science|artificial intelligence|machine learning|cyber[\s-]?security|"
    r"robotics|computer engineering)\b"
)
ENGINEERING_TERMS = (
    r"\b(?:engineering|electrical|electronics|mechanical|civil|chemical|biomedical|aerospace|environmental|energy|materials|industrial|mechatronics|"
    r"automation|manufacturing)\b"
)

# Kinds of urls that are no programme or catalogue, the first that matches counts.
NON_PROGRAM_KINDS = (
    ("editorial-search-legal", r"/(?:news|noticies|events?|stories|story|blogs?|articles?|press|media|search|website-disclaimer)(?:/|$)|\.rss$"),
    ("corporate-organization-research", r"/(?:companies|about-lut|research|governance|campuses|universite/international|educational-initiatives)(?:/|$)"),
    ("services-facilities-campus-life", r"/(?:it-services|quality-system|rooms|university-life|what-do-you-need|administrative-procedures|appointments|mailbox|grants-and-financial-aid|new-students|organizing-your-studies-and-where-to-go-for-advice)(?:/|$)"),
)
NON_MASTER_DEGREE_PATH = r"(?:^|[./_-])(?:undergraduate|bachelors?|doctoral|doctorate|phd)(?:[./_-]|$)"
MALFORMED_TRACKING_PATH = r"(?:^|/)(?:&|%26)utm_[a-z0-9_%-]+="
GENERIC_DIRECTORY_PATH = r"/by-areas-of-knowledge/"

# Signals of catalogue links with their scores.
CATALOGUE_SIGNALS = (
    ("master-level", 6, (
        r"\b(?:master(?:s| degree| programme| program| course| study| studies)?|msc|m sc|m a|meng|m eng|llm|magister|maestria|maestrias|mestrado|mestrados|"
        r"masterstudium|masterstudiengang|masterstudiengange|masterprogramme|masterprogram|masterprogrammer|masterutbildningar|masteropleiding|"
        r"masteropleidingen|maisteriohjelma|maisteriohjelmat|studia magisterskie|yuksek lisans)\b|\u7855\u58eb|\u7814\u7a76\u751f"
    )),
    ("postgraduate-level", 5, (
        r"\b(?:postgraduate|post graduate|postgrado|postgrados|posgrado|posgrados|pos graduacao|laurea magistrale|lauree magistrali|second cycle|deuxieme cycle|"
        r"cycle master|lisansustu)\b"
    )),
    ("graduate-level", 3, r"\bgraduate(?: studies| study| education)?\b"),
    ("catalogue", 3, (
        r"\b(?:catalog|catalogue|all programmes|all programs|programme finder|program finder|degree finder|course finder|find a programme|find a program|"
        r"explore programmes|explore programs|study options|studienangebot|oferta academica|oferta formativa|catalogue des formations)\b"
    )),
    ("programme-list", 3, (
        r"\b(?:programmes|programs|degrees|courses|formations|studiengange|studiengaenge|study programmes|study programs|corsi di laurea|programas|cursos|"
        r"opleidingen)\b"
    )),
    ("study-area", 1, r"\b(?:study|studies|education|academic)\b"),
)
# Signals against them.
CATALOGUE_NEGATIVE_SIGNALS = (
    ("event-or-news", -12, r"\b(?:news|events?|webinars?|open days?|open house|information session|press|stories|blog)\b"),
    ("non-degree-content", -10, (
        r"\b(?:research projects?|publications?|staff|people|alumni|jobs?|vacancies|library|contact|about us|privacy|cookies?|login|sign in|current students?|"
        r"student information|information (?:for )?.* students|academic calendars?|calendario academico|cronograma|schedules?)\b"
    )),
    ("admissions-only", -6, r"\b(?:admissions?|application|apply|entry requirements?|eligibility|deadlines?|tuition|fees|scholarships?|how to apply)\b"),
    ("wrong-level", -8, (
        r"\b(?:bachelor|undergraduate|doctoral|doctorate|phd|continuing education|doctorado|doctorados|especialidad|especialidades|especializacion|postitulo|"
        r"postitulos|pre master|foundation|executive education|short courses?|summer schools?)\b"
    )),
)
CATALOGUE_REJECT_PATH = (
    r"/(?:news|events?|webinars?|research|publications?|people|staff|jobs?|vacanc(?:y|ies)|press|blog|privacy|cookies?|login|contact|about|alumni|"
    r"admissions?|apply|application|how-to-apply|requirements?|fees?|scholarships?|calendars?|calendario[^/]*|schedules?)(?:/|$)"
)
GENERIC_DIRECTORY_SEGMENT = (
    r"^(?:masters?|graduate|postgraduate|programmes?|programs?|degrees?|courses?|catalog(?:ue)?|study|studies|education|formations?|maestrias?|mestrados?|"
    r"posgrados?|postgrados?|masterstudiengange|masterstudiengaenge|masteropleidingen|lauree magistrali|oferta academica|oferta formativa)$"
)

# Keywords of engineering, and ones next to it that never count alone.
HIGH_KEYWORDS = (
    "engineering", "engineer", "aerospace", "aeronautical", "architectural", "automotive", "biomedical", "chemical", "civil", "electrical",
    "electronic", "environmental", "geotechnical", "industrial", "manufacturing", "materials", "mechanical", "mechatronic", "nuclear",
    "petroleum", "robotics", "structural", "telecommunications", "telecommunication", "transportation", "energy systems", "engineering physics",
    "engineering science", "software engineering", "computer engineering", "systems engineering", "data engineering",
)
ADJACENT_KEYWORDS = (
    "technology", "technical", "computing", "informatics", "information systems", "computer science", "data science", "physics", "architecture",
    "biotechnology",
)
