"""Lexicons: which words speak for which key.  All of them are parameters; these are the defaults."""

from __future__ import annotations

# Words that speak for a domain, in order of precedence.
DOMAINS = {
    "medical_ai": ("окт", "oct", "врач", "doctor", "диагноз", "diagnosis", "клиническ", "clinical", "пациент", "patient", "медиц", "medical", "hospital", "glaucoma", "глауком", "ophthalm"),
    "education_ai": ("cefr", "lesson", "tutor", "student", "learning path", "обучен", "курс", "course", "учеб", "education", "teacher", "curriculum"),
    "enterprise_ai": ("enterprise", "corporate", "organization", "корпорат", "b2b", "saas"),
    "analytics_platform": ("analytics", "dashboard", "kpi", "clustering", "trend", "аналит", "дашборд", "semantic search", "indlab"),
    "neuroassistant": ("neuro", "brain", "eeg", "нейро", "cognitive", "neuroassistant"),
    "rag_system": ("rag", "retrieval", "vector", "qdrant", "embedding", "knowledge base", "chromadb", "pinecone", "faiss"),
    "multi_agent_system": ("agent", "orchestrator", "planner", "critic", "multi-agent", "crew", "autogen", "langgraph"),
    "computer_vision": ("yolo", "detection", "bbox", "image", "cv", "segmentation", "opencv", "computer vision", "classification model"),
    "speech_ai": ("stt", "whisper", "diarization", "audio", "transcript", "speech", "asr", "tts", "voice"),
    "hr_ai": ("hr", "recruitment", "hiring", "candidate", "resume", "кадр", "hrtech"),
    "sales_ai": ("crm", "sales", "lead", "conversion", "pipeline", "продаж", "лид"),
    "document_ai": ("docx", "pdf", "document processing", "ocr", "extraction", "парсинг", "document ai"),
    "infrastructure_ai": ("kubernetes", "devops", "cloud", "infrastructure", "terraform", "microservice deploy", "инфраструктур"),
}
# Marks of source types, in order of precedence.
SOURCE_TYPES = {
    "ready_landing_doc": ("суть проекта", "задачи проекта", "для чего", "вводные данные", "выходные данные", "результаты проекта", "перспектива развития", "используемый технологический стек", "команда проекта"),
    "pptx_project_presentation": (
        "цель проекта", "цели проекта", "этапы проекта", "этапы работы", "подготовка данных", "итоги проекта", "демо", "шаг 1", "шаг 2",
        "ссылки на первоисточники", "стажировка", "slide ", "метрики и результаты", "архитектура системы", "архитектура пайплайна",
    ),
    "technical_spec": ("техническое задание", "тз", "требования", "функциональные требования", "нефункциональные требования", "входные данные", "выходные данные", "api", "интеграция"),
    "report": ("отчёт", "отчет", "итоги", "результаты", "проведено", "реализовано", "рекомендации", "метрики"),
    "team_list": ("команда", "тимлид", "помощник тимлида", "участники"),
    "architecture_doc": ("архитектура", "pipeline", "модули", "сервисы", "backend", "frontend", "data layer", "llm", "rag"),
}
# Technologies by the text that names them: (category, name).
TECHNOLOGIES = {
    "yolov8": ("AI / ML / CV", "YOLOv8"), "yolo": ("AI / ML / CV", "YOLO"), "opencv": ("AI / ML / CV", "OpenCV"), "computer vision": ("AI / ML / CV", "Computer Vision"),
    "ocr": ("AI / ML / CV", "OCR"), "whisper": ("AI / ML / CV", "Whisper"), "faster-whisper": ("AI / ML / CV", "Faster-Whisper"), "pyannote": ("AI / ML / CV", "pyannote"),
    "bertopic": ("AI / ML / CV", "BERTopic"), "llm": ("AI / ML / CV", "LLM"), "rag": ("AI / ML / CV", "RAG"), "embeddings": ("AI / ML / CV", "Embeddings"),
    "qwen": ("AI / ML / CV", "Qwen"), "openai": ("AI / ML / CV", "OpenAI"), "gpt": ("AI / ML / CV", "GPT"), "faiss": ("Data / Search / Graph", "FAISS"),
    "qdrant": ("Data / Search / Graph", "Qdrant"), "neo4j": ("Data / Search / Graph", "Neo4j"), "postgresql": ("Data / Search / Graph", "PostgreSQL"), "postgres": ("Data / Search / Graph", "PostgreSQL"),
    "redis": ("Data / Search / Graph", "Redis"), "pgvector": ("Data / Search / Graph", "pgvector"), "elasticsearch": ("Data / Search / Graph", "Elasticsearch"), "python": ("Backend / App", "Python"),
    "fastapi": ("Backend / App", "FastAPI"), "django": ("Backend / App", "Django"), "streamlit": ("Backend / App", "Streamlit"), "flask": ("Backend / App", "Flask"),
    "websocket": ("Backend / App", "WebSocket"), "rest api": ("Backend / App", "REST API"), "react": ("Frontend", "React"), "next.js": ("Frontend", "Next.js"),
    "typescript": ("Frontend", "TypeScript"), "tailwind": ("Frontend", "Tailwind"), "html": ("Frontend", "HTML"), "css": ("Frontend", "CSS"),
    "cvat": ("Annotation / CV tools", "CVAT"), "roboflow": ("Annotation / CV tools", "Roboflow"), "supervision": ("Annotation / CV tools", "Supervision"), "google colab": ("Annotation / CV tools", "Google Colab"),
    "colab": ("Annotation / CV tools", "Google Colab"), "docker": ("Infra", "Docker"), "docker compose": ("Infra", "Docker Compose"), "gpu": ("Infra", "GPU"),
    "cuda": ("Infra", "CUDA"), "nginx": ("Infra", "Nginx"), "cloudflare tunnel": ("Infra", "Cloudflare Tunnel"), "spacy": ("AI / ML / CV", "spaCy"),
    "pyrogram": ("Backend / App", "Pyrogram"), "sentence transformers": ("AI / ML / CV", "Sentence Transformers"), "huey": ("Backend / App", "Huey"), "jwt": ("Backend / App", "JWT"), "bcrypt": ("Backend / App", "bcrypt"),
}
# Placeholder prefixes of entity types.
PREFIXES = {
    "person_name": "PERSON",
    "email": "EMAIL",
    "phone": "PHONE",
    "address": "ADDRESS",
    "url": "URL",
    "organization": "ORG",
    "medical_data": "MEDICAL",
    "passport_id": "ID",
    "telegram": "TELEGRAM",
    "role_person": "ROLE",
}
# Precedence of entity types where spans overlap; others have 5.
PRIORITIES = {"person_name": 10, "role_person": 9, "email": 10, "phone": 10, "medical_data": 3, "organization": 5}
# How much sources and parsers count.
ROLE_PRIORITY = {"primary_project_doc": 100, "ready_landing_doc": 90, "supporting_presentation": 60, "module_presentation": 20, "report": 70, "auxiliary": 40, "unknown": 30}
PARSER_PRIORITY = {"structured": 95, "multi_source_assembly": 85, "project_presentation": 70, "heuristic": 40}
HEADINGS = ("задачи проекта", "этапы работы", "схема обработки данных", "результаты проекта", "перспектива развития")
# The words that this project's test tables hold, for queries over them.
SAMPLE_DOMAINS = {"licensing": ("license", "mit ", "apache", "gnu"), "secrets": ("token", "password", "akia"), "trends": ("trend", "rag", "llm"), "contact": ("@", "example.com", "+1 (")}

# Words that speak for the profile of a record, in order of precedence.
PROFILES = {
    "medical": ("medical", "clinical", "patient", "hospital", "diagnosis", "медиц", "клиник", "пациент"),
    "education": ("education", "learning", "course", "student", "обучен", "курс", "студент", "учеб"),
    "ai_research": ("ai", "ml", "model", "research", "llm", "neural", "исследован", "модель", "нейро"),
    "analytics": ("analytics", "dashboard", "metrics", "kpi", "аналит", "дашборд", "метрик", "отчет"),
    "enterprise": ("enterprise", "corporate", "organization", "корпорат", "предприят", "организац"),
    "neuro": ("neuro", "brain", "eeg", "нейро", "мозг"),
    "fintech": ("fintech", "bank", "payment", "finance", "финтех", "банк", "платеж"),
    "infrastructure": ("infrastructure", "cloud", "devops", "kubernetes", "инфраструктур", "облак"),
    "cybersecurity": ("security", "cyber", "compliance", "audit", "безопасност", "кибер", "комплаенс"),
}
# Archetypes of systems, the domain each needs (None: any) and its words.
ARCHETYPES = {
    "AI Copilot": ("medical_ai", ("copilot", "assistant", "врач", "doctor", "physician", "real-time")),
    "RAG Knowledge Assistant": ("rag_system", ("rag", "retrieval", "knowledge base", "vector", "embedding")),
    "Multi-Agent Orchestrator": ("multi_agent_system", ("orchestrator", "multi-agent", "planner", "critic", "agent")),
    "Analytics Dashboard": ("analytics_platform", ("dashboard", "analytics", "kpi", "visualization", "clustering")),
    "Decision Support System": ("medical_ai", ("decision support", "clinical audit", "second opinion", "diagnosis", "диагноз")),
    "Workflow Automation Platform": (None, ("workflow", "automation", "pipeline", "orchestration")),
    "Document Processing Pipeline": ("document_ai", ("docx", "pdf", "document", "extraction", "ocr")),
    "Realtime Speech Pipeline": ("speech_ai", ("whisper", "stt", "diarization", "transcript", "audio")),
    "CV Diagnostic Assistant": ("computer_vision", ("yolo", "detection", "image", "bbox", "segmentation")),
    "Learning Platform": ("education_ai", ("lesson", "tutor", "student", "cefr", "learning path", "course")),
    "Recommendation Engine": (None, ("recommendation", "scoring", "personalized", "planning", "vitacalc")),
}
# Patterns of architectures, their words and the block that they stand for; and what a domain adds.
PATTERNS = {
    "ingestion pipeline": ("ingestion", "upload", "extract", "parse", "etl"),
    "RAG pipeline": ("rag", "retrieval", "embedding", "vector", "qdrant"),
    "multi-agent orchestration": ("agent", "orchestrator", "planner", "crew"),
    "event-driven architecture": ("kafka", "event", "pubsub", "queue", "rabbitmq"),
    "real-time streaming": ("websocket", "stream", "real-time", "realtime", "live"),
    "human-in-the-loop": ("human-in-the-loop", "physician", "review", "audit", "validation"),
    "privacy-first architecture": ("pii", "privacy", "mask", "redact", "gdpr", "hipaa"),
    "microservices": ("microservice", "kubernetes", "docker", "service mesh"),
    "monolith MVP": ("monolith", "mvp", "fastapi", "single service"),
    "API gateway": ("gateway", "api gateway", "nginx", "kong"),
    "async worker pipeline": ("celery", "worker", "async", "background job", "redis queue"),
    "vector search": ("vector", "embedding", "similarity search", "qdrant", "faiss"),
    "semantic enrichment": ("semantic", "enrichment", "nlp", "llm enrich"),
    "clinical decision support": ("clinical", "diagnosis", "decision support", "cdss"),
    "scoring engine": ("scoring", "score", "ranking", "classifier"),
    "recommendation engine": ("recommend", "personalized", "planning"),
}
PATTERN_BLOCKS = {
    "stack": ("ingestion pipeline", "event-driven architecture", "privacy-first architecture", "microservices", "monolith MVP", "API gateway", "async worker pipeline", "vector search"),
    "architecture": ("RAG pipeline", "real-time streaming"),
    "modules": ("multi-agent orchestration",),
    "tasks": ("human-in-the-loop", "semantic enrichment"),
    "results": ("clinical decision support", "scoring engine", "recommendation engine"),
}
PATTERN_BOOSTS = {("RAG pipeline", "rag_system"): (0.08, 0.95), ("real-time streaming", "speech_ai"): (0.06, 0.92)}
# The sections of a page by profile, its layout and its style.
SECTION_PLANS = {
    "medical": ("essence", "architecture", "compliance", "pipeline", "metrics", "validation", "stack", "team", "roadmap"),
    "education": ("essence", "learning_flow", "system", "modules", "metrics", "stack", "team", "roadmap"),
    "analytics": ("essence", "dashboards", "pipeline", "ingestion", "orchestration", "metrics", "stack", "roadmap"),
    "ai_research": ("problem", "system", "architecture", "modules", "metrics", "validation", "stack", "team", "roadmap"),
    "cybersecurity": ("essence", "architecture", "compliance", "pipeline", "metrics", "stack", "team", "roadmap"),
}
SECTION_PLAN = ("problem", "system", "architecture", "modules", "metrics", "stack", "team", "roadmap")
LAYOUTS = {
    "medical": "architecture_first", "education": "research_report", "analytics": "dashboard", "ai_research": "technical_system", "enterprise": "enterprise_overview", "cybersecurity": "architecture_first",
    "infrastructure": "technical_system", "fintech": "enterprise_overview", "neuro": "research_report", "general": "architecture_first",
}
STYLES = {
    "medical": "medical", "education": "education", "analytics": "analytics", "ai_research": "ai_research", "neuro": "ai_research", "enterprise": "enterprise", "fintech": "enterprise", "infrastructure": "enterprise",
    "cybersecurity": "enterprise", "general": "enterprise",
}
