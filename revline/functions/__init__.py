from revline.functions.ids import content_hash, finding_id  # noqa: F401
from revline.functions.severity import (grade, grade_colour, heat, meets_threshold,  # noqa: F401
                                        severity_rank, severity_weight)
from revline.functions.text import (line_count, mask_secrets, normalize_newlines,  # noqa: F401
                                    py_title_from_snake, split_lines)
