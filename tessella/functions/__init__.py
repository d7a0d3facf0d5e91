"""Column functions: text, slugs, JSON, numbers and colours. All built-in expressions unless said otherwise."""
