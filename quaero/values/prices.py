"""Price lists and planning defaults. All of them are fixed values."""

# Fixed value: provider, label, category, USD per million input and output tokens.
LANGUAGE_MODELS = [
    ("local_ollama", "Local · Ollama (qwen3:8b)", "self_hosted", 0.0, 0.0),
    ("groq_llama70b", "Groq · Llama 3.3 70B", "cloud", 0.59, 0.79),
    ("groq_gpt_oss_120b", "Groq · openai/gpt-oss-120b", "cloud", 0.15, 0.60),
    ("groq_llama8b", "Groq · Llama 3.1 8B Instant", "cloud", 0.05, 0.08),
    ("openai_gpt4o_mini", "OpenAI · GPT-4o mini", "cloud", 0.15, 0.60),
    ("openai_gpt4o", "OpenAI · GPT-4o", "cloud", 2.50, 10.00),
    ("openai_gpt41", "OpenAI · GPT-4.1", "cloud", 2.00, 8.00),
    ("anthropic_haiku", "Anthropic · Claude 3.5 Haiku", "cloud", 0.80, 4.00),
    ("anthropic_sonnet", "Anthropic · Claude Sonnet 4", "cloud", 3.00, 15.00),
    ("google_flash", "Google · Gemini 2.0 Flash", "cloud", 0.10, 0.40),
    ("google_pro", "Google · Gemini 1.5 Pro", "cloud", 1.25, 5.00),
    ("mistral_small", "Mistral · Small", "cloud", 0.10, 0.30),
    ("deepseek_chat", "DeepSeek · Chat", "cloud", 0.27, 1.10),
]
LANGUAGE_MODEL_FALLBACK = "groq_llama70b"
LANGUAGE_MODEL_DEFAULT = "groq_gpt_oss_120b"
LANGUAGE_MODEL_LOCAL = "local_ollama"
# Fixed value: providers compared with one another.
COMPARED_MODELS = [
    "local_ollama", "groq_llama8b", "groq_gpt_oss_120b", "groq_llama70b", "openai_gpt4o_mini",
    "openai_gpt4o", "anthropic_haiku", "anthropic_sonnet", "google_flash", "deepseek_chat",
    "mistral_small",
]
# Fixed value: provider, label, USD per million tokens.
EMBEDDERS = [
    ("local_bge_m3", "Local · BGE-M3", 0.0),
    ("openai_embed_3_small", "OpenAI · text-embedding-3-small", 0.02),
    ("openai_embed_3_large", "OpenAI · text-embedding-3-large", 0.13),
    ("voyage_2", "Voyage · voyage-2", 0.10),
]
EMBEDDER_DEFAULT = "local_bge_m3"
# Fixed value: provider, label, USD per thousand queries.
RERANKERS = [
    ("local_bge", "Local · bge-reranker-v2-m3", 0.0),
    ("cohere_rerank", "Cohere · Rerank 3.5", 2.00),
]
RERANKER_DEFAULT = "local_bge"

# Fixed value: monthly planning defaults.
PLAN = {
    "infra_fixed_usd": 55.0, "electricity_usd": 28.0, "storage_usd": 12.0, "bandwidth_usd": 14.0,
    "support_hours": 16.0, "support_hourly_usd": 15.0, "target_profit_usd": 450.0,
    "margin_pct": 30.0, "fx_mdl": 17.85, "active_users": 200, "requests_per_user_month": 28.0,
    "avg_input_tokens": 1400, "avg_output_tokens": 420, "tool_calls_per_q": 1.3,
    "tool_extra_in": 400, "tool_extra_out": 120, "avg_chunk_tokens": 400,
    "monthly_refresh_share": 0.05,
}
CORPUS_TARGET = 5000
