"""Fixed word lists and thresholds of the ranking model, one place each. All values here are fixed values."""

from __future__ import annotations

#: Canonical skill names; the lower-cased name is a variant of each. Fixed values.
CANONICAL_SKILLS = """
JavaScript|TypeScript|Node.js|React|Angular|Vue.js|Express|NestJS|Next.js|Python|Django|Django REST Framework|Flask|FastAPI|Pandas|NumPy|
SciPy|Matplotlib|Scikit-learn|TensorFlow|PyTorch|Keras|MongoDB|PostgreSQL|MySQL|Redis|SQL|T-SQL|PL/SQL|NoSQL|Elasticsearch|Docker|Kubernetes|
Git|GitHub|GitLab|Bitbucket|Jenkins|CircleCI|Travis CI|GitHub Actions|GitLab CI|Bamboo|TeamCity|Azure DevOps|AWS|GCP|Azure|OpenShift|Linux|
Red Hat|C#|.NET|.NET Core|.NET Framework|ASP.NET|Java|Spring|Spring Boot|React Native|Flutter|Swift|SwiftUI|Kotlin|Android|iOS|HTML|CSS|
Tailwind CSS|Bootstrap|SASS|SCSS|Redux|NgRx|MobX|Cesium|OpenLayers|Leaflet|GIS|ArcGIS|ArcGIS Pro|QGIS|Jest|Mocha|Cypress|Selenium|Pytest|
Go|Rust|PHP|Ruby|Ruby on Rails|C++|C|R|Scala|Wireshark|Scapy|Mission Planner|Splunk|GraphQL|REST|REST API|RabbitMQ|Kafka|
Apache Spark|PySpark|Hadoop|Apache Airflow|Jira|Confluence|Figma|Postman
""".replace("\n", "").split("|")  # fmt: skip

#: Other variants, by canonical name. Fixed values. (Forms with a version after a space are stripped before the lookup.)
SKILL_ALIASES = {
    "JavaScript": "java script|js|ecmascript|es6|es2015|es2020", "TypeScript": "type script|ts", "Node.js": "node|nodejs|node js|node-js|nodej",
    "React": "reactjs|react.js|react js|react-js", "Angular": "angularjs|angular.js|angular js|angular2", "Vue.js": "vue|vuejs|vue js|vue2|vue3",
    "Express": "expressjs|express.js|express js", "NestJS": "nest|nest.js|nest js", "Next.js": "next|nextjs|next js", "Python": "py|python3|python2",
    "Django": "django rest", "Django REST Framework": "djangorestframework|drf", "FastAPI": "fast api|fast-api", "Scikit-learn": "sklearn|scikit learn",
    "TensorFlow": "tensor flow|tf", "PyTorch": "torch", "MongoDB": "mongo|mongo db|mongo-db", "PostgreSQL": "postgres|postgre|psql|postgres sql|postgres-sql",
    "MySQL": "my sql|my-sql", "T-SQL": "tsql", "PL/SQL": "plsql", "NoSQL": "no sql|no-sql", "Elasticsearch": "elastic search|elastic", "Kubernetes": "k8s|k8",
    "CircleCI": "circle ci", "Travis CI": "travis", "AWS": "amazon web services", "GCP": "google cloud|google cloud platform", "Azure": "microsoft azure",
    "OpenShift": "open shift", "Linux": "ubuntu|centos", "Red Hat": "redhat", "C#": "csharp|c sharp|c-sharp", ".NET": "dotnet|dot net", ".NET Core": "dotnet core",
    "ASP.NET": "asp net|aspnet", "Java": "java8|java11|java17", "Spring": "spring framework", "Spring Boot": "springboot", "React Native": "react-native|reactnative",
    "HTML": "html5", "CSS": "css3", "Tailwind CSS": "tailwind|tailwindcss", "Redux": "react-redux|react redux", "Cesium": "cesiumjs|cesium.js", "OpenLayers": "open layers",
    "Leaflet": "leafletjs", "ArcGIS Pro": "gis pro|arc gis pro", "ArcGIS": "arc gis", "Cypress": "cypress.io", "Go": "golang", "PHP": "php7|php8", "Ruby on Rails": "rails|ror",
    "C++": "cpp|cplusplus", "R": "rstudio", "Mission Planner": "missionplanner", "GraphQL": "graph ql", "REST": "restful", "REST API": "restful api", "RabbitMQ": "rabbit mq",
    "Kafka": "apache kafka", "Apache Spark": "spark", "Hadoop": "apache hadoop", "Apache Airflow": "airflow", "Jira": "atlassian jira", "Confluence": "atlassian confluence", "Bamboo": "atlassian bamboo",
}


def skill_variants() -> dict[str, str]:
    """variant (lower-case) -> canonical name, from the two lists above."""
    out = {c.lower(): c for c in CANONICAL_SKILLS}
    return out | {v: c for c, variants in SKILL_ALIASES.items() for v in variants.split("|")}


#: Technical vocabulary by bucket, buckets in order of precedence. Fixed values.
VOCABULARY = {
    "languages": "javascript|typescript|python|java|go|ruby|rust|scala|php|swift|kotlin|c#|c++|c|node.js|r|matlab|perl|shell|bash|html|css|scss|sass|vhdl|verilog|assembly|embedded c",
    "frameworks": "react|react native|express|express.js|spring|django|flask|fastapi|angular|vue|next.js|nextjs|nuxt|dotnet|.net|tailwindcss|bootstrap|redux|graphql|jquery|context api",
    "databases": "postgres|postgresql|mysql|mariadb|mongodb|snowflake|bigquery|oracle|redis|dynamodb|elasticsearch|sql|nosql|cassandra|sqlite",
    "cloud": "aws|azure|gcp|google cloud|digitalocean|heroku|cloud",
    "tools": "git|github|gitlab|docker|kubernetes|k8s|jenkins|terraform|ansible|jira|confluence|notion|slack|figma|selenium|cypress|appium|testrail|testng|junit|pytest|postman|soapui|jmeter|vscode|intellij|powershell|bash|shell|vite|webpack|rollup|parcel|zod|tanstack-query|tanstack query|mui|drizzle-orm|drizzle orm|ci/cd|rest api|rest apis|rest|graphql|websocket|websockets|opentelemetry|playwright|jest|github copilot|copilot|cursor|windsurf|wireshark|metasploit|nmap|burp suite|kali linux|splunk|snort|ida pro|ghidra|volatility|autopsy|cryptography|penetration testing|vulnerability assessment|firewalls|ids|ips|siem|soar|dlp",
    "business": "crm|salesforce|hubspot|b2b|b2c|b2g|g2g|marketing|negotiation|lead generation|go-to-market|gtm|tenders|rfp|rfq|contracting|pricing|channels|partnerships|account management|pipeline|forecast|customer success",
    "management": "agile|scrum|kanban|ci/cd|devops|waterfall|qa strategy|risk management|stakeholder management|mentoring|coaching|leadership|budgeting|planning",
    "domains": "cybersecurity|embedded systems|embedded|network security|network protection|communication protocols|can bus|i2c|spi|uart|tcp/ip|udp|modbus|scada|iot|rtos|freertos|real-time|firmware|hardware|weapon systems|defense systems|defense|military|aerospace",
}
KEYWORD_BLACKLIST = ["excel", "word", "powerpoint", "outlook"]
AMBIGUOUS_SHORT_TERMS = ["go", "c", "r", "d", "e", "f", "k", "p", "s", "w"]
PROGRAMMING_CONTEXT = ["programming", "language", "code", "developer", "experience in"]
HUMAN_LANGUAGES = ["english", "hebrew", "french", "german", "spanish", "arabic", "russian"]

#: Role categories in order of precedence, with the title substrings of each. Fixed values.
ROLE_SYNONYMS = {
    "software_engineer": "software engineer|software developer|programmer|coder|application developer|software dev|swe|engineer|developer",
    "full_stack": "full stack developer|full stack engineer|fullstack developer|fullstack engineer|full-stack developer|full-stack engineer|fs developer|fs engineer|full stack dev",
    "frontend": "frontend developer|frontend engineer|front-end developer|front-end engineer|front end developer|ui developer|web developer|client-side developer|fe developer",
    "backend": "backend developer|backend engineer|back-end developer|back-end engineer|server-side developer|api developer|be developer|backend dev",
    "mobile": "mobile developer|mobile engineer|mobile app developer|ios developer|android developer|mobile dev|app developer|mobile software engineer",
    "data_scientist": "data scientist|ds|data science engineer|applied scientist|research scientist|ai scientist",
    "ml_engineer": "machine learning engineer|ml engineer|mle|ai engineer|deep learning engineer|ml ops engineer",
    "data_engineer": "data engineer|de|big data engineer|data platform engineer|analytics engineer",
    "data_analyst": "data analyst|business analyst|bi analyst|analytics specialist|reporting analyst",
    "devops": "devops engineer|devops|site reliability engineer|sre|infrastructure engineer|platform engineer|cloud engineer",
    "cloud_architect": "cloud architect|cloud solutions architect|aws architect|azure architect|gcp architect",
    "security_engineer": "security engineer|cybersecurity engineer|infosec engineer|application security engineer|appsec engineer",
    "qa_engineer": "qa engineer|quality assurance engineer|test engineer|sdet|qa automation engineer|qa tester|quality engineer",
    "product_manager": "product manager|pm|product owner|po|technical product manager|senior product manager",
    "ux_designer": "ux designer|user experience designer|ux/ui designer|product designer|interaction designer|ui/ux designer",
    "solutions_architect": "solutions architect|software architect|system architect|enterprise architect|technical architect",
    "engineering_manager": "engineering manager|em|development manager|software engineering manager|team lead|tech lead",
}
#: Adjacent categories, from the job's category to the candidate's. Fixed values.
ROLE_NEIGHBOURS = {
    "software_engineer": "full_stack|backend|frontend|mobile", "full_stack": "software_engineer|backend|frontend",
    "backend": "software_engineer|full_stack|data_engineer|devops", "frontend": "software_engineer|full_stack|ux_designer", "mobile": "software_engineer|frontend",
    "data_scientist": "ml_engineer|data_analyst|data_engineer", "ml_engineer": "data_scientist|data_engineer|backend", "data_engineer": "data_scientist|ml_engineer|backend|devops",
    "data_analyst": "data_scientist|data_engineer", "devops": "cloud_architect|backend|security_engineer|data_engineer", "cloud_architect": "devops|solutions_architect",
    "security_engineer": "devops|backend", "qa_engineer": "backend|frontend|devops", "product_manager": "ux_designer", "ux_designer": "frontend|product_manager",
    "solutions_architect": "cloud_architect|backend|devops", "engineering_manager": "software_engineer|solutions_architect",
}

#: Words and terms of titles and skills. Fixed values.
TITLE_TERMS = "engineer|developer|programmer|architect|lead|manager|director|analyst|specialist|consultant|scientist|researcher|designer|software|full stack|fullstack|backend|frontend|web|mobile|cloud|data|machine learning|ml|devops|qa|test|security|network|database|embedded|systems|platform|infrastructure|senior|sr|junior|jr|principal|staff|chief|head|entry|associate".split("|")
STRONG_TITLE_TERMS = "engineer|developer|programmer|architect|software|full stack|fullstack|backend|frontend".split("|")
LEADERSHIP_TERMS = "lead|manager|head|director|vp|chief|principal|senior".split("|")
TECH_JOB_TERMS = "engineer|developer|architect|devops|sre|programmer|data scientist".split("|")
HR_TERMS = "recruiter|talent acquisition|hr |human resources|sourcing|headhunter".split("|")
SOFT_WORDS = "operations|response|analysis|protocols|management|methodologies|practices|principles|communication|teamwork|collaboration|troubleshooting|monitoring|documentation".split("|")
GENERIC_SKILL_WORDS = "scripting|programming|development|developer|experience|knowledge|skills|proficiency|familiarity|fundamentals".split("|")
BANNED_ROLE_TITLES = "projects|experience|education|skills|summary|פרויקטים|ניסיון|השכלה|מיומנויות|סיכום".split("|")

#: Role classification. Fixed values.
TECH_TITLE_WORDS = "developer|engineer|software|frontend|front end|backend|back end|full stack|devops|sre|site reliability|data|ml|machine learning|ai|android|ios|mobile|architect|security|platform|automation|qa|programmer|coder|tech lead|technical lead|tech|cybersecurity|cyber".split("|")
STRONG_TECH_TITLES = "developer|engineer|programmer|data scientist|devops|cyber|architect|sre".split("|")
WEAK_TECH_TITLES = "technician|support|help desk|operator|controller|admin|administrator|instructor|assistant|student|intern|analyst".split("|")
TECH_COMPANY_WORDS = "tech|software|technology|systems|digital|cyber|ai|data".split("|")
ACADEMIC_WORDS = "university|college|school|technion|institute|academy|ben gurion|tel aviv|hebrew u".split("|")
MILITARY_WORDS = "iaf|idf|air force|ofek|tzahal|army|navy|military".split("|")
TECH_WORK_WORDS = "develop|code|program|build|implement|deploy|api|system|software".split("|")
STRONG_TECH = "python|java|c++|c#|javascript|typescript|react|node|aws|docker".split("|")
#: Title inference: keywords per title in order; two hits needed but for the first. Fixed values.
INFERRED_TITLES = {
    "AI Developer": "ai-powered|ai based|machine learning|ml|gemini|openai|llm",
    "Frontend Developer": "frontend|front-end|react|angular|vue|ui/ux", "Backend Developer": "backend|back-end|api|server|database",
    "Software Developer": "developed|built|implemented|programmed", "DevOps Engineer": "devops|ci/cd|docker|kubernetes|jenkins|deployment",
    "Data Scientist": "data analysis|data science|analytics|machine learning",
}

#: Raw terms of the deterministic skill scan; their canonical names are those of the dictionary above. Fixed values.
SCAN_TERMS = "python|py|r|java|c#|csharp|c++|go|javascript|typescript|ts|php|ruby|scala|rust|react|vue|angular|nextjs|tailwind|html|html5|css|css3|node|node js|node.js|express|nest|nestjs|spring|.net|dotnet|django|flask|fastapi|pandas|numpy|scikit-learn|xgboost|lightgbm|spark|airflow|cesium|openlayers|sql|postgres|postgresql|mysql|mongodb|docker|kubernetes|k8s|git|jenkins|linux|openshift|splunk|aws|gcp|azure".split("|")
SPOKEN = "hebrew|english|arabic|russian|french|spanish|german".split("|")

#: Patterns. Fixed values.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?<!\d)\+?\d[\d\s().\-]{7,}\d(?!\d)"
YEAR_RANGE = r"^\s*\d{4}\s*[-–—]\s*\d{4}\s*$"
URL = r"(?i)https?://[^\s)\]]+"
LINKEDIN = r"(?i)https?://(?:www\.)?linkedin\.com/[^\s)\]]+"
GITHUB = r"(?i)https?://(?:www\.)?github\.com/[^\s)\]]+"
HEADING = (
    r"(?i)^\s*(experience|professional\s+experience|work\s+experience|work\s+history|employment(?:\s+history)?|education|academic\s+background|qualifications|"
    r"skills(?:\s*&\s*abilities)?|technical\s+skills|core\s+competencies|expertise|projects|summary|languages|certifications|achievements|"
    r"ניסיון|ניסיון\s+תעסוקתי|ניסיון\s+מקצועי|השכלה|השכלה\s+אקדמית|מיומנויות|כישורים|פרויקטים|סיכום|שפות|הסמכות)\s*[:\-]?\s*$"
)
HEBREW_MONTHS = "ינואר|פברואר|מרץ|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר".split("|")

#: Score thresholds. Fixed values.
GOOD_SCORE, TITLE_GENTLE, EMBED_DIMS = 70, 0.75, (768, 1536, 3072)
W_TITLE, W_EXPERIENCE, W_SKILLS = 0.55, 0.25, 0.20
LISTED_SKILL_WEIGHT = 0.6
