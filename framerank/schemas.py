"""Fixed schemas, as DDL: nothing is inferred from files."""

PREDICTIONS = "game_name string, clip_name string, frame_path string, pred_label string, confidence double"
SEGMENTS = "segment_id int, game_name string, clip_name string, priority string, num_frames int, start_frame string, end_frame string"
METRICS = "luminance double, sharpness double, uniformity double, texture double"
SIGNALS = (
    "num_faces int, face_area double, face_quality double, face_det_score double, face_visibility double, emotion_intensity double, "
    "emotion_label string, pose_score double, pose_label string, closeup double, iqa_norm double, logo_p double"
)
KEYFRAMES = (
    "video_id string, rank int, segment_id int, segment_priority string, segment_multiplier double, keyframe_priority int, content_source string, "
    "final_score double, score_pre_mult double, w_content double, w_iqa double, iqa_signal double, model_confidence double, num_faces int, "
    "w_emotion double, emotion_signal double, emotion_label string, w_face double, face_signal double, face_visibility double, w_pose double, "
    "pose_signal double, input_path string, saved_path string"
)
CLUSTER_LOG = "cluster_id string, stage string, path string, score double, selected boolean, cluster_size int, segment_id int"
ANNOTATIONS = "annotations array<struct<gameTime: string, label: string, position: string>>"
TEAM = "struct<name: string, short_name: string, logo_url: string>"
EVENT = (
    "score string, game_time long, game_phase string, tag struct<action: string, player_name: string, scorer: string>, "
    "playlist struct<video_url: string, thumbnail_url: string, description: string, frontend_url: string, duration_ms: long, recording_timestamp: string, "
    "events: array<struct<video_asset_id: string>>, game: struct<id: long, date: string, phase: string, stadium_name: string, tournament_name: string, "
    f"attendance: long, home_team: {TEAM}, visiting_team: {TEAM}>>"
)
COCO = "images array<struct<id: long, file_name: string>>, annotations array<struct<image_id: long, bbox: array<double>>>"
POSE_TRUTH = "keypoint_2d map<string, struct<name: string, x: double, y: double>>"
DATASET = "label string, game string, filename string, rel_path string, augmented int"
